"""The queries of this package in DuckDB SQL, where it can express them."""

#: Lower-cased words: runs of ASCII letters and digits and of other characters.
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DUP = f"""
with recursive texts as (
    select distinct md5(text) as node, {WORDS} as w from documents where text is not null
), bags as (
    select node, unnest(case when len(w) >= 5
        then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        else [array_to_string(w, ' ')] end) as shingle
    from texts where len(w) > 0
), tokens as (
    select node, shingle, row_number() over (partition by node, shingle) as k from bags
), sizes as (
    select node, count(*) as size from bags group by node
), links as (
    select a, b
    from (select x.node as a, y.node as b, count(*) as shared
          from tokens x join tokens y on x.shingle = y.shingle and x.k = y.k and x.node <> y.node
          group by x.node, y.node)
    join sizes sa on sa.node = a join sizes sb on sb.node = b
    where 9 * shared >= 4 * (sa.size + sb.size)
), reach(node, root) as (
    select node, node from sizes union select l.b, r.root from reach r join links l on l.a = r.node
), classes as (
    select node, min(root) as root from reach group by node
), placed as (
    select doc_id, root from documents left join classes on node = md5(text)
)
select doc_id, coalesce(min(doc_id) over (partition by root), doc_id) as class_id from placed where root is not null
union all select doc_id, doc_id from placed where root is null
"""

DECONTAMINATE = f"""
with items as (
    select cast(item_id as varchar) as item, {WORDS} as w from benchmark
), grams as (
    select distinct item, least(len(w), 10) as n,
           unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                                 lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as gram
    from items where len(w) > 0
), texts as (
    select row_number() over () as r, doc_id, coalesce({WORDS}, []) as w from documents
), places as (
    select r, w, n, unnest(range(1, len(w) - n + 2)) as i from texts, (select distinct n from grams)
), hits as (
    select distinct r, i, n, item
    from (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as gram from places) join grams using (n, gram)
), words as (
    select r, count(distinct k) as n_hit
    from (select distinct r, unnest(range(i, i + n)) as k from hits) group by r
), found as (
    select r, count(distinct item) as n_items, sha256(array_to_string(list_sort(list(distinct item)), ',')) as items_sha256
    from hits group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from texts left join words using (r) left join found using (r)
"""

LINE_DEDUP = f"""
with split as (
    select doc_id, md5(text) as t, unnest(string_split(text, chr(10))) as text,
           unnest(range(len(string_split(text, chr(10))))) as line
    from documents
), worded as (
    select doc_id, t, line, text, list_sort(list_distinct({WORDS})) as w from split
), sets as (
    select array_to_string(w, ' ') as s, any_value(w) as w, min(struct_pack(a := doc_id, b := line)) as first
    from worded where len(w) > 0 group by 1
), tokens as (
    select s, len(w) as size, unnest(w) as token from sets
), links as (
    select x.s as a, y.s as b
    from tokens x join tokens y on x.token = y.token and x.s < y.s
        and 5 * x.size >= 4 * y.size and 5 * y.size >= 4 * x.size
    group by x.s, y.s, x.size, y.size
    having 9 * count(*) >= 4 * (x.size + y.size)
), later as (
    select distinct x.s from (select a, b from links union all select b, a from links) l
    join sets x on x.s = l.a join sets y on y.s = l.b where y.first < x.first
), judged as (
    select doc_id, t, line, text, len(worded.w) > 0 and (later.s is not null
           or struct_pack(a := doc_id, b := line) > sets.first) as gone
    from worded left join sets on sets.s = array_to_string(worded.w, ' ') and len(worded.w) > 0
    left join later on later.s = sets.s
), docs as (
    select doc_id, t, count(*) filter (gone) as n_removed,
           coalesce(string_agg(line::varchar, ',' order by line) filter (gone), '') as removed_lines,
           sha256(coalesce(string_agg(text, chr(10) order by line) filter (not gone), '')) as kept_sha256
    from judged group by doc_id, t
)
select doc_id, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed_lines, '') as removed_lines,
       coalesce(kept_sha256, sha256('')) as kept_sha256
from documents left join docs d using (doc_id) where d.t is not distinct from md5(documents.text)
"""

WARC = """
with rows as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
    from pages
), many as (
    select payload_digest, max(page_id) as top from rows where payload_bytes >= 1000 group by 1
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when top is null or page_id is not distinct from top then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from top then top end as refers_to
from rows left join many using (payload_digest)
"""

COLLOCATIONS = f"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents where text is not null
), worded as (
    select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces
), totals as (
    select lang, sum(len(w))::bigint as n from worded group by lang
), counts as (
    select lang, phrase, size, count(*) as f
    from (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
          from worded, (select unnest([1, 2, 3]) as size) where len(w) >= size)
    group by all
), candidates as (
    select *, string_split(phrase, ' ') as w from counts where size >= 2 and f >= 10
), kept as (
    select * from candidates c where not exists (
        select 1 from candidates d
        where d.lang = c.lang and d.size > c.size and 100 * d.f >= 50 * c.f
          and (array_to_string(d.w[1:c.size], ' ') = c.phrase or array_to_string(d.w[2:c.size + 1], ' ') = c.phrase))
), cuts as (
    select lang, phrase, w, f, unnest(range(1, size)) as k from kept
), scored as (
    select cuts.lang, cuts.phrase, cuts.f as a, x.f as l, y.f as r, k,
           (1000000::hugeint * cuts.f * cuts.f) // (x.f::hugeint * y.f) as score
    from cuts
    join counts x on x.lang = cuts.lang and x.phrase = array_to_string(cuts.w[1:k], ' ')
    join counts y on y.lang = cuts.lang and y.phrase = array_to_string(cuts.w[k + 1:], ' ')
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""

ALL = {
    "op6_warc": WARC,
    "op2_line_dedup": LINE_DEDUP,
    "op1_near_duplicates": NEAR_DUP,
    "op7_decontaminate": DECONTAMINATE,
    "op13_collocations": COLLOCATIONS,
}
