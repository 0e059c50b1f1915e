"""Benchmark decontamination with built-in expressions only.

Every window of benchmark words is a row of a table; every window of a document is
looked up in it as text, so a hit is exact and needs no second look. The table is
broadcast if its size allows, else both sides shuffle. Only hits are aggregated.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbwait.llm.arrow import fresh
from curbwait.session import written

WINDOW = 10
#: ASCII besides letters and digits, one by one: Java looks a class of single characters
#: up in a table, and asks one of ranges range after range, several times as slow.
_OTHER = "".join(f"\\x{c:02X}" for c in range(0x80) if not chr(c).isalnum())


def words_of(text: str) -> Column:
    """Words: runs of ASCII letters and digits and of all other characters, A-Z in
    lower case; none for null."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _cut(lowered)


def _cut(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"[^{_OTHER}]++"), F.lit(0)), F.expr("array()"))


def _windows(words: str, length: str) -> Column:
    """The texts of all runs of ``length`` words, at their positions."""
    return F.expr(
        f"""case when size({words}) >= {length} then
              transform(sequence(0, size({words}) - {length}), i -> array_join(slice({words}, i + 1, {length}), ' '))
            else cast(array() as array<string>) end"""
    )


def grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``gram``, its ``length`` in words, and ``items``, the sorted ids of the items
    that have it as a window. An item of fewer words than a window, but not none, is
    one window; an item without an id still marks words as hit."""
    worded = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("w"))
    return (
        worded.where("size(w) > 0")
        .withColumn("length", F.least(F.size("w"), F.lit(window)))
        .select("item", "length", F.explode(_windows("w", "length")).alias("gram"))
        .groupBy("gram", "length")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_limit: int = 64 << 20
) -> DataFrame:
    """Per hit document ``doc_id`` and ``key`` (of its text), ``spans``: the merged
    runs of hit words, (at, to) by word index, and ``items``: sorted distinct ids.

    Equal rows are one document here.
    """
    table, _ = written(grams(benchmark, window), "grams")
    size = table.agg(
        F.sum(F.length("gram") + 64), F.collect_set("length"), F.max(F.size("items"))
    ).first()  # at most `window` lengths
    sets = table.select(F.md5(F.concat_ws(",", "items")).alias("set"), "items").dropDuplicates(["set"])
    table = table.select("gram", "length", F.md5(F.concat_ws(",", "items")).alias("set"))
    if (size[0] or 0) <= broadcast_limit:
        table = F.broadcast(table)
    worded = docs.where("text is not null").select("doc_id", key().alias("key"), words_of("text").alias("w"))
    tables = [
        worded.select("doc_id", "key", F.lit(n).alias("length"), F.posexplode(_windows("w", str(n))).alias("at", "gram"))
        for n in sorted(size[1] or [window])
    ]
    found = tables[0]
    for more in tables[1:]:
        found = found.unionByName(more)
    per_doc = (
        found.join(table, ["gram", "length"])
        .groupBy("doc_id", "key")
        .agg(
            F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("to")))).alias("hit"),
            F.collect_set("set").alias("sets"),
        )
    )
    merge = """aggregate(hit, cast(array() as array<struct<at:int,to:int>>), (done, h) ->
        case when size(done) > 0 and element_at(done, -1).to >= h.at
          then concat(slice(done, 1, size(done) - 1),
                      array(named_struct('at', element_at(done, -1).at, 'to', greatest(element_at(done, -1).to, h.to))))
          else concat(done, array(h)) end)"""
    return (
        per_doc.select("doc_id", "key", F.expr(merge).alias("spans"), F.explode("sets").alias("set"))
        .join(sets, "set")
        .groupBy("doc_id", "key")
        .agg(
            F.first("spans").alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    )


def key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text)))


def judged(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_limit: int = 64 << 20
) -> DataFrame:
    """The documents with ``n_words``, ``spans`` and ``items`` (empty where clean).

    A null text has no words; rows that repeat each get the same answer; an empty
    benchmark hits nothing. Columns of these names give way to the new ones.
    """
    docs = docs.drop("n_words", "spans", "items")
    key_, id_, hit_ = (fresh(docs, name) for name in ("_key", "_id", "_hit"))
    found = hits(docs, benchmark, window, broadcast_limit).toDF(id_, hit_, "spans", "items")
    rows = docs.withColumn(key_, key()).withColumn("n_words", F.size(_cut(F.col("text"))))
    same = rows["doc_id"].eqNullSafe(found[id_]) & (rows[key_] == found[hit_])
    return (
        rows.join(found, same, "left")
        .withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<at:int,to:int>>)")))
        .withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
        .drop(key_, id_, hit_)
    )


def n_hit() -> Column:
    """Words inside hits, from ``spans``."""
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.to - s.at)")


def cleaned(judged_docs: DataFrame, most: float = 0.5) -> DataFrame:
    """Judged documents with hit words, and what stands before each, cut from their
    texts; a document is dropped if more than a share ``most`` of its words is hit."""
    chunks = F.regexp_extract_all("text", F.lit(f"([{_OTHER}]*[^{_OTHER}]+)"), F.lit(0))
    tail = F.regexp_extract("text", f"([{_OTHER}]*)\\z", 1)
    kept = F.filter(chunks, lambda c, i: ~F.exists("spans", lambda s: (s["at"] <= i) & (i < s["to"])))
    cut = F.concat(F.array_join(kept, ""), tail)
    return (
        judged_docs.where(n_hit() <= most * F.col("n_words"))
        .withColumn("text", F.when(F.size("spans") > 0, cut).otherwise(F.col("text")))
        .drop("n_words", "spans", "items")
    )
