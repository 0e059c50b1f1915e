"""Documents with the awkward cases, and brute-force versions of what operators do."""

from pyspark.sql import types as T

WORDS = (
    "stone river amber falcon meadow quiet lantern copper willow harbor "
    "thunder velvet marble saddle pepper orchid timber candle ribbon glacier"
).split()

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # names that operators use themselves
        T.StructField("hash", T.StringType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("spans", T.StringType()),
        T.StructField("removed", T.StringType()),
        T.StructField("_hash", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("stats", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)


def frame(spark, rows):
    """Documents from (doc_id, text), with all the extra columns."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "h", "p", "s", "k") for i, t in rows], DOCS)


def prose(random, n):
    """A text of n made-up words in lines of about ten."""
    made = ["".join(random.choices("abcdefghijklmnop", k=random.randint(3, 8))) for _ in range(n)]
    return "\n".join(" ".join(made[k : k + 10]) for k in range(0, n, 10))


AWKWARD = [
    (1, None),
    (2, ""),
    (2, ""),
    (None, "stone river amber falcon meadow quiet lantern"),
    (3, "..."),
    (4, "stone"),
    (5, "stone river amber falcon meadow quiet lantern"),
    (5, "stone river amber falcon meadow quiet lantern"),
    (6, "la " * 3000),
    (7, "été à l’œuvre\n\n\nété à l’œuvre"),
]
