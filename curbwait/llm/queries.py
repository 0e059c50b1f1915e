"""One query per corpus operator over its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from curbwait.llm import (
    collocations,
    decontaminate,
    language,
    line_dedup,
    near_dup,
    packing,
    periodic_runs,
    pii,
    quality,
    sim_hash,
    suffix_dedup,
    token_orc,
    tokens,
    warc,
)
from curbwait.llm.arrow import appended
from curbwait.session import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the class of near duplicates it is in."""
    return near_dup.near_duplicates(_table(spark, folder, "documents")).select("doc_id", "class_id")


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines removed from each document, and what is left of its text."""
    found = line_dedup.deduped(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.concat_ws(",", F.transform("removed", lambda k: k.cast("string"))).alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes removed from each document, and a digest of those left."""
    found = suffix_dedup.deduped(_table(spark, folder, "documents").select("doc_id", "text"))
    size = "coalesce(octet_length(text), 0)"
    return found.selectExpr(
        "doc_id",
        f"cast({size} as bigint) as n_bytes",
        f"cast({size} - octet_length(kept) as bigint) as n_removed",
        "cast(size(removed) as bigint) as n_spans",
        "sha2(kept, 256) as kept_sha256",
    )


def _with_crc(pieces: DataFrame, keep: list[str]) -> DataFrame:
    """The columns kept, and the crc32 of ``ids``."""
    crc = lambda batch: [tokens.crc32(batch.column(batch.schema.get_field_index("ids")))]
    return appended(pieces, [T.StructField("ids_crc32", T.LongType())], crc, keep)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the documents, and where they are in the sequences."""
    digest = lambda rows: _with_crc(rows, [c for c in rows.columns if c != "ids"])
    return packing.pack(docs, tokens.default_path(), derive=digest).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op4_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packed(_table(spark, folder, "documents"))


def op10_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, read back from the ORC files."""
    path = scratch_path(spark, "token_orc")
    token_orc.write_tokens(_table(spark, folder, "documents"), path, tokens.default_path())
    return _with_crc(token_orc.read_tokens(spark, path), ["doc_id", "start", "n_tokens"])


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document, learned on three quarters of them."""
    docs = _table(spark, folder, "documents").withColumn(
        "held_out", F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)")
    )
    model = language.train(docs.where("not held_out"))
    return language.predicted(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The record of each page, read back from normalised archives."""
    found = warc.round_trip(_table(spark, folder, "pages"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words and benchmark items hit in each document."""
    found = decontaminate.judged(
        _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        F.col("n_words").cast("long"),
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of plain identifiers in each document, and the spans of all."""
    found = pii.scanned(_table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    listed = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
    counts = [
        F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint) as n_{kind}") for kind in pii.KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each document and whether the learned rules keep it."""
    docs = _table(spark, folder, "documents")
    rules = quality.learn(docs, _table(spark, folder, "labels"))
    return quality.judged(docs.select("doc_id", "text"), rules, ["doc_id"]).selectExpr(
        "doc_id",
        *(f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "base_failed",
        "kept",
    )


def _with_tails(docs: DataFrame) -> DataFrame:
    """Doc_id and text, where one document in ten has a periodic end put in: of n words,
    each from word a on is one of the next p words after a, over and over."""
    marked = docs.selectExpr("doc_id", "text", "crc32(cast(cast(doc_id as string) as binary)) as h")
    worded = marked.selectExpr(
        "doc_id",
        "text",
        "h div 10 as g",
        "if(h % 10 = 0, filter(split(text, '[ \\t-\\r]+'), w -> w <> ''), array()) as words",
    )
    placed = worded.selectExpr("*", "if(size(words) > 0, g % size(words), null) as a")
    period = placed.selectExpr("*", "1 + (size(words) - a) div (3 + g % 8) as p")
    tail = "transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)]))"
    return period.selectExpr("doc_id", f"if(a is null, text, array_join({tail}, ' ')) as text")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of each document, its most periodic one, and what is left without repeats."""
    docs = _with_tails(_table(spark, folder, "documents"))
    listed = "transform(runs, r -> concat_ws(',', string(r.start), string(r.length), string(r.period)) || '\n')"
    first = """(x.length * y.period > y.length * x.period or (x.length * y.period = y.length * x.period
        and (x.start < y.start or (x.start = y.start and x.period < y.period))))"""
    best = f"reduce(runs, runs[0], (y, x) -> if({first}, x, y))"
    return (
        periodic_runs.collapsed(docs, keep=["doc_id"])
        .selectExpr("*", f"if(size(runs) > 0, {best}, null) as best")
        .selectExpr(
            "doc_id",
            "cast(size(runs) as bigint) as n_runs",
            "best.start",
            "best.length",
            "best.period",
            "1000 * best.length div best.period as exponent_milli",
            f"sha2(array_join({listed}, ''), 256) as runs_sha256",
            "sha2(collapsed, 256) as collapsed_sha256",
        )
    )


def op12_sim_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of each document and the component it is in."""
    found = sim_hash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.selectExpr("doc_id", "lpad(lower(hex(fingerprint)), 16, '0') as fingerprint", "component_id")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first phrases of each language."""
    return collocations.collocations(_table(spark, folder, "documents"))


ALL = [
    op1_near_duplicates,
    op2_line_dedup,
    op3_suffix_dedup,
    op4_pack,
    op5_language,
    op6_warc,
    op7_decontaminate,
    op8_personal_data,
    op9_quality,
    op10_token_orc,
    op11_periodic_runs,
    op12_sim_hash,
    op13_collocations,
]
