"""Token ids in ORC: one row a document, files and rows in ascending doc_id order.

Integer columns are run-length encoded; stripes carry row indexes and a Bloom filter
on ``doc_id``, so a lookup by id skips files, stripes and row groups by metadata, and
readers split the files at stripes.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbwait.llm.tokens import encoded, lists

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, stripe_bytes: int = 16 << 20) -> None:
    """Encode every text, ``end`` appended, and write the ids below ``path``.

    Rows are dealt by ranges of (doc_id, text hash), documents without an id last,
    so that rows with one id spread as well. A null text has ``end`` only; repeated
    rows are all written; other columns are not read.
    """
    ordered = (
        docs.selectExpr("cast(doc_id as bigint) as doc_id", "text", "xxhash64(text) as h")
        .repartitionByRange(F.col("doc_id").asc_nulls_last(), "h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "h")
    )

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                ids, offsets = encoded(some.column("text"), tokenizer, end)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        pa.array(np.full(some.num_rows, part, np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        lists(ids, offsets),
                    ],
                    names=SCHEMA.fieldNames(),
                )
                start += int(offsets[-1])

    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``.

    A part's first id is found from the totals of the parts, one row each.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    bases = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select(  # a row for each task that wrote
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )
