"""Trips kept by driver and slice of time, so that pairing again costs little.

``store_bucketed`` keeps them in buckets, and reading pairs without a shuffle.
``SessionFiles`` takes file after file: only slices that a new file has trips in are read
and paired again.
"""

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbwait.operators.next_fare import (
    SLICE_SECONDS,
    firsts,
    led_in_slices,
    stitched,
    turns,
    with_slice,
)
from curbwait.schemas import DRIVER, TRIP_ORDER
from curbwait.session import exists


def store_bucketed(
    trips: DataFrame,
    name: str,
    path: str,
    buckets: int = 200,
    seconds: int = SLICE_SECONDS,
    order: Sequence[str] = TRIP_ORDER,
) -> None:
    """Trips as the table ``name`` below ``path``, in buckets by driver and slice, sorted,
    and beside it ``name_turns``, the first trip of each driver's next slice, in the
    same buckets. Trips have a driver and a pick-up time, as clean ones do."""

    def save(df: DataFrame, table: str) -> None:
        writer = df.repartition(buckets, DRIVER, "slice").write.mode("overwrite").format("parquet")
        writer = writer.bucketBy(buckets, DRIVER, "slice").sortBy(DRIVER, "slice")
        writer.option("path", f"{path}/{table}").saveAsTable(table)

    sliced = with_slice(trips, seconds)
    save(sliced, name)
    following = turns(firsts(sliced, order))
    save(following.withColumnsRenamed({"_driver": DRIVER, "_slice": "slice"}), f"{name}_turns")


def next_fare_bucketed(spark: SparkSession, name: str, order: Sequence[str] = TRIP_ORDER) -> DataFrame:
    """As ``next_fare``, from the two tables: windows and the join use their buckets."""
    following = spark.table(f"{name}_turns").withColumnsRenamed({DRIVER: "_driver", "slice": "_slice"})
    return stitched(led_in_slices(spark.table(name), order), following, null_safe=False)


class SessionFiles:
    """Trips led within their slices, in a folder by generation and slice.

    Every append is a generation. It writes the slices that its trips are in, with the
    trips these had before, and says so in a table of slices; the latest generation of a
    slice counts. That table, a row for each slice and append, is all the driver reads.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: int = SLICE_SECONDS, order: Sequence[str] = TRIP_ORDER):
        self._spark, self._folder, self._seconds, self._order = spark, folder, seconds, order

    def _latest(self) -> dict[int, str]:
        """The generation that counts, by slice."""
        if not exists(self._spark, f"{self._folder}/slices"):
            return {}
        rows = self._spark.read.parquet(f"{self._folder}/slices").groupBy("slice").agg(F.max("at").alias("at"))
        return {r["slice"]: r["at"] for r in rows.collect()}

    def _held(self, kind: str, chosen: dict[int, str]) -> DataFrame:
        base = f"{self._folder}/{kind}"
        paths = [f"{base}/at={at}/slice={s}" for s, at in sorted(chosen.items())]
        return self._spark.read.option("basePath", base).parquet(*paths).drop("at").withColumn(
            "slice", F.col("slice").cast("long")
        )

    def touched(self, trips: DataFrame) -> DataFrame:
        """The trips, with those already held in their slices: what an append pairs."""
        sliced, latest = with_slice(trips, self._seconds), self._latest()
        slices = [r["slice"] for r in sliced.select("slice").distinct().collect()]  # a row a day
        again = {s: latest[s] for s in slices if s in latest}
        return sliced.unionByName(self._held("trips", again).select(sliced.columns)) if again else sliced

    def append(self, trips: DataFrame) -> None:
        """Take more trips; they may lie before, among or after those held. Trips have a
        driver and a pick-up time. Until its last step an append changes nothing that
        counts, so one that failed is called again. One at a time."""
        done = {at for at in self._latest().values()}
        at = f"{1 + max((int(a.split('-')[0]) for a in done), default=0):06d}-{uuid.uuid4().hex}"
        led = led_in_slices(self.touched(trips).repartition(DRIVER, "slice"), self._order)
        led.withColumn("at", F.lit(at)).write.mode("append").partitionBy("at", "slice").parquet(f"{self._folder}/trips")
        if not exists(self._spark, f"{self._folder}/trips/at={at}"):
            return  # no trips
        base = self._spark.read.option("basePath", f"{self._folder}/trips")
        written = base.parquet(f"{self._folder}/trips/at={at}").withColumn("slice", F.col("slice").cast("long"))
        opening = firsts(written, self._order).withColumn("at", F.lit(at))
        opening.write.mode("append").partitionBy("at", "slice").parquet(f"{self._folder}/firsts")
        slices = written.select("slice").distinct().withColumn("at", F.lit(at))
        slices.write.mode("append").parquet(f"{self._folder}/slices")

    def next_fare(self) -> DataFrame:
        """All trips held, paired, as ``next_fare`` does it in one go. Trips are not
        shuffled into order again; what is, has a row for each driver's slice."""
        latest = self._latest()
        if not latest:
            raise ValueError(f"no trips in {self._folder}")
        return stitched(self._held("trips", latest), turns(self._held("firsts", latest)))
