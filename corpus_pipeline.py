"""Documents to training sequences: five stages, each over all the one before kept."""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbwait.llm import decontaminate, line_dedup, near_dup, quality
from curbwait.llm.arrow import bounded
from curbwait.llm.queries import packed
from curbwait.session import written


def _columns_aside(stage: Callable) -> Callable:
    """The stage on documents whose columns besides ``doc_id`` and ``text`` have names
    that no operator uses; they get their own back."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        aside = [n if n in ("doc_id", "text") else f"_source_{k}" for k, n in enumerate(names)]
        return stage(spark, docs.toDF(*aside), sf_dir).select(*aside).toDF(*names)

    return run


@_columns_aside
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the learned rules and the base rules keep."""
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs, rules).where("kept")


@_columns_aside
def similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines similar to earlier ones; those that have no word
    left are dropped."""
    found = line_dedup.deduped(docs)
    worded = F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    return found.where((F.size("removed") == 0) | worded)


@_columns_aside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.one_of_each(docs)


@_columns_aside
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words that lie in benchmark windows."""
    found = decontaminate.judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.cleaned(found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, and where they are in the training sequences."""
    return packed(docs)


def _in_small_batches(stage: Callable) -> Callable:
    """The stage with its workers' batches bounded, until its result is written too."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", _in_small_batches(quality_rules)),
    ("line dedup", _in_small_batches(similar_lines)),
    ("near duplicates", _in_small_batches(near_duplicates)),
    ("benchmark passages", _in_small_batches(benchmark_passages)),
    ("packing", _in_small_batches(pack)),
]

#: The learned rules and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
