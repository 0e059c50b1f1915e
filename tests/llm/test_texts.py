"""Language, personal data, quality rules, decontamination and archives."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, WORDS, frame, prose

from curbwait.llm import decontaminate, language, pii, quality, warc
from curbwait.session import scratch_path

FOLDER = "/root/testdata/sf0.01"


def test_language_on_documents_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.train(docs.where("doc_id % 4 <> 2"))
    rows = language.predicted(docs.where("doc_id % 4 = 2"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    made = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(6)] for k in range(80)}
    text = lambda name: " ".join(rng.choices(made[name], k=40))
    # of the last languages one document only
    docs = [(name, text(name)) for k, name in enumerate(made) for _ in range(1 if k >= 60 else 3)]
    model = language.train(spark.createDataFrame(docs, "lang string, text string"))
    assert model.languages == sorted(made)
    asked = [(name, text(name)) for name in made]
    rows = language.predicted(spark.createDataFrame(asked, "lang string, text string"), model).collect()
    assert len(rows) == 80 and all(r.lang == r.lang_pred for r in rows)


def test_code_lengths_follow_the_counts():
    text = "abracadabra abracadabra"
    symbols = language._PLAIN[np.frombuffer(text.encode(), np.uint8)]
    padded = [0, 0, 0, *symbols.tolist()]
    strings = [tuple(padded[k : k + 4]) for k in range(len(symbols))]
    number = lambda s: int(sum(x << 6 * (3 - k) for k, x in enumerate(s)))
    counts = Counter(strings)
    grams = sorted((number(s), n) for s, n in counts.items())
    model = language.Model(["x"], language._PLAIN, [tuple(np.array(c) for c in zip(*grams, strict=True))])
    costs = language.Costs(model)

    def cost(string):
        """The longest context that has the symbol, and escapes from longer ones."""
        bits = 0.0
        for order in (3, 2, 1, 0):
            context = string[3 - order : 3]
            after = Counter()
            for s, n in counts.items():
                if s[3 - order : 3] == context:
                    after[s[3]] += n
            total, kinds = sum(after.values()), len(after)
            if after[string[3]]:
                return bits - np.log2(after[string[3]] / (total + kinds))
            if total:
                bits -= np.log2(kinds / (total + kinds))
        return bits + 6

    for string in [*counts, (1, 2, 18, 26), (5, 5, 5, 1), (1, 2, 18, 1), (0, 0, 0, 7)]:
        assert costs.lengths(np.array([number(string)]))[0, 0] == pytest.approx(cost(string), rel=1e-5)


def test_language_of_awkward_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(100)
    model = language.train(docs)
    rows = language.predicted(frame(spark, [*AWKWARD, (8, "Ωμέγα"), (9, "12 34")]), model).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 9}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    none = language.train(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in language.predicted(frame(spark, AWKWARD), none).collect()} == {"und"}
    assert language.predicted(frame(spark, []), model).collect() == []


def plain(text):
    """The four patterns, taken literally."""
    out = [
        (m.start(), m.end(), "email")
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    ]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_plain_identifiers_agree_with_the_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choices("ab1290.@-+ ()%é", k=rng.randint(0, 30)))
        assert pii.plain(text) == plain(text)


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write john (at) example [dot] com please", "email", "john (at) example [dot] com"),
        ("jane dot roe at example dot org", "email", "jane dot roe at example dot org"),
        ("ｊｏｈｎ＠example．com!", "email", "ｊｏｈｎ＠example．com"),
        ("аdmin@exаmple.com", "email", "аdmin@exаmple.com"),
        ("at 192[.]168[.]1[.]7 now", "ip", "192[.]168[.]1[.]7"),
        ("plus four nine one five one two three four five six seven", "phone",
         "plus four nine one five one two three four five six seven"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguises(text, kind, part):
    base, spans = pii.find(text)
    assert (text.index(part), text.index(part) + len(part), kind) in spans


@pytest.mark.parametrize(
    "text, kind",
    [
        ("jane (at) example dot org", "email"),
        ("jane at example [dot] org", "email"),
        ("jane@example dot org", "email"),
        ("jane at example.org", "email"),
        ("jane dot roe [at] mail.example dot org", "email"),
        ("jane at mail dot example dot org", "email"),
        ("jane arroba example punto org", "email"),
        ("jane arobase example.org", "email"),
        ("jane chez example point org", "email"),
        ("jane at example punkt org", "email"),
        ("j\u200bane (at) ｅxample dot org", "email"),
        ("one nine two dot one six eight dot one dot seven", "ip"),
        ("one nine two [dot] one six eight dot 1.seven", "ip"),
        ("192 dot 168.1 [.] 7", "ip"),
        ("four nine one five one two three four five six seven eight nine one", "phone"),
        ("four nine one five one two three four five six seven eight nine one two", "phone"),
    ],
)
def test_mixed_disguises(text, kind):
    base, spans = pii.find(f"ask: {text}, or not")
    assert base == [] and spans == [(5, 5 + len(text), kind)]


@pytest.mark.parametrize(
    "text",
    ["look at example.org", "he came at noon.Then he left", "they looked at one point last year", "one. two. three. four."],
)
def test_clean_signs_stay_clean(text):
    assert pii.find(text) == ([], [])


def test_disguises_in_time():
    for text in ("a dot " * 40_000, "a-" * 100_000 + " dot at b.c", "a at b dot " * 20_000, "1 dot " * 40_000, " " * 200_000 + " dot "):
        start = time.process_time()
        pii.find(text)
        assert time.process_time() - start < 5


@pytest.mark.parametrize("text", ["meet me at noon", "one two three", "(at) last", "the dot at the end", "1 2 3 4 5 6 7"])
def test_clean_texts_stay_clean(text):
    assert pii.find(text) == ([], [])


def test_pii_rows(spark):
    rows = pii.scanned(frame(spark, [*AWKWARD, (8, "a@b.cd " + " " * 200_000 + "[" * 1000)])).collect()
    assert {r.doc_id: len(r.spans) for r in rows if r.spans} == {8: 1}
    assert pii.scanned(frame(spark, [])).collect() == []


def stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_counts_agree_with_plain_python(spark):
    rng = random.Random(9)
    rows = list(AWKWARD)
    for k in range(60):
        rows.append((100 + k, "".join(rng.choices(["a", "bé", "日", " ", "\n", "\t", "#", "a a a"], k=rng.randint(0, 120)))))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality.text_stats(frame(spark, rows).drop("stats")).collect()
    assert sorted((repr(r.text), *(r.stats[n] for n in names)) for r in found) == sorted(
        (repr(t), *stats(t)) for _, t in rows
    )


def test_rules_hold_on_labels_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = quality.learn(docs, labels.where("doc_id % 3 > 0"))
    rows = quality.judged(docs, rules, ["doc_id"]).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    judged = [(r.quality, r.kept) for r in rows if not r.base_failed]
    assert np.mean([kept for good, kept in judged if good]) > 0.995
    assert np.mean([kept for good, kept in judged if not good]) < 0.05


def test_rules_without_labels(spark):
    docs = frame(spark, AWKWARD)
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    assert rules.rules == ()
    rows = quality.judged(docs, rules).collect()
    assert len(rows) == len(AWKWARD) and all(r.kept != r.base_failed for r in rows)
    assert quality.judged(frame(spark, []), rules).collect() == []


def words_of(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_hits_agree_with_all_windows(spark):
    rng = random.Random(7)
    items = [(k, " ".join(rng.choices(WORDS, k=n))) for k, n in enumerate([12, 30, 4, 1, 10])]
    items += [(9, None), (10, ""), (None, "Glacier ribbon glacier!")]
    rows = list(AWKWARD)
    for k in range(40):
        parts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 30))), rng.choice(items)[1] or "", prose(rng, 10)]
        rng.shuffle(parts)
        rows.append((100 + k, ", ".join(parts).title()))
    grams = {}
    for item, text in items:
        w = words_of(text)
        for k in range(len(w) - min(len(w), 10) + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(item)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limit in (64 << 20, -1):
        found = {}
        docs = frame(spark, rows)
        judged = decontaminate.judged(docs, benchmark, broadcast_limit=limit)
        for r in judged.withColumn("n_hit", decontaminate.n_hit()).collect():
            found.setdefault(repr((r.doc_id, r.text)), []).append((r.n_words, r.n_hit, r["items"]))
        for doc, text in rows:
            w = words_of(text)
            hit, ids = set(), set()
            for gram, of in grams.items():
                for k in range(len(w) - len(gram) + 1):
                    if tuple(w[k : k + len(gram)]) == gram:
                        hit |= set(range(k, k + len(gram)))
                        ids |= of
            wanted = (len(w), len(hit), sorted(str(i) for i in ids if i is not None))
            assert set(map(str, found[repr((doc, text))])) == {str(wanted)}


def test_words_are_found_by_a_table(spark):
    assert not re.search("[^\\\\]-|\\\\x..-", decontaminate._OTHER)
    texts = ["".join(chr(c) + "aZ" for c in range(0x180)), "x" * 20_000 + "-" * 20_000 + "y", "\U0001f600[K]", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(decontaminate.words_of("text"))
    assert [r[0] for r in rows.collect()] == [words_of(t) for t in texts]


def test_cleaned_texts_lose_the_passage_only(spark):
    passage = " ".join(WORDS)
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rest = prose(random.Random(1), 40)
    docs = frame(spark, [(1, f"{rest}. {passage.title()}!"), (2, rest), (3, passage), (4, None)])
    found = decontaminate.cleaned(decontaminate.judged(docs, benchmark)).collect()
    assert {r.doc_id: r.text for r in found} == {1: f"{rest}!", 2: rest, 4: None}


def test_empty_benchmark(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.judged(frame(spark, AWKWARD), benchmark).collect()
    assert len(rows) == len(AWKWARD) and not any(r.spans or r["items"] for r in rows)
    assert decontaminate.judged(frame(spark, []), benchmark).collect() == []


def test_archives_round_trip(spark):
    rng = random.Random(3)
    big = prose(rng, 400)
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (7, "http://b", big), (7, "http://b", big), (3, "u", None),
            (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nsmall"), (6, "u", "WARC/1.1\r\n\r\nsmall"), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = scratch_path(spark, "warc")
    found = warc.round_trip(pages, folder).collect()
    wanted = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = raw == big.encode() and page != 7
        wanted.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 7 if again else None,
                       None if again else raw))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
             None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(map(repr, have)) == sorted(map(repr, wanted))
    none = warc.round_trip(pages.where("page_id > 99"), scratch_path(spark, "warc"))
    assert none.collect() == []


def test_records_are_split_at_any_chunk():
    rows = [{"page_id": k, "url": "u", "payload": b"x\r\n\r\n" * k, "payload_bytes": 5 * k,
             "payload_digest": hashlib.sha1(b"x\r\n\r\n" * k).hexdigest(), "record_type": "response", "refers_to": None}
            for k in range(20)]
    made = [warc.record(r) for r in rows]
    stream = b"".join(made)
    for size in (1, 7, 100, 10_000):
        assert list(warc.split(stream[k : k + size] for k in range(0, len(stream), size))) == made
    with pytest.raises(ValueError):
        list(warc.split([stream[:-3]]))
