"""Counts, statistics and classes by region; membership tests."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def distribution(located: DataFrame, by: str = "borough") -> DataFrame:
    """Rows per region, most first."""
    return (
        located.groupBy(by).agg(F.count("*").alias("count")).orderBy(F.desc("count"), by)
    )


def unknown_regions(names: DataFrame, zones: DataFrame, by: str = "borough") -> DataFrame:
    """Region names the zone table does not have."""
    return names.select(by).distinct().join(zones.select(by), by, "left_anti")


def rows_of_regions(located: DataFrame, names: Sequence[str], by: str = "borough") -> DataFrame:
    return located.where(F.col(by).isin(list(names)))


def not_in(rows: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose value in ``on`` is not among the listed ones, by the rules of
    SQL's NOT IN: a missing value in the list leaves no rows, and a row with a
    missing value stays only beside an empty list. A value of several columns
    counts as missing if any of them is.

    NOT IN itself would need the whole list on every executor. Here what the list
    holds is asked once by a subquery, and its distinct values, once for each salt,
    are joined on equality with the rows, each in a salt picked by all its columns.
    """
    missing = " or ".join(f"{c} is null" for c in on)
    held = listed.selectExpr(
        f"struct(count(*) as rows, count_if({missing}) as missing)"
    ).scalar()
    whole = ", ".join(f"`{c}`" for c in rows.columns)
    present = rows.where(f"not ({missing})").selectExpr("*", f"cast(pmod(xxhash64({whole}), {SALTS}) as int) as _salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    values = listed.select(*on).distinct().withColumn("_salt", salts)
    kept = present.join(values, [*on, "_salt"], "left_anti")
    return (
        kept.where(held["missing"] == 0)
        .select(rows.columns)
        .unionByName(rows.where(missing).where(held["rows"] == 0))
    )


def idle_by_region(od: DataFrame) -> DataFrame:
    """Mean and sample deviation of the minutes to the next fare, by the region
    of the drop-off, shortest first."""
    return (
        od.groupBy("dropoff_borough")
        .agg(
            F.avg("next_fare_duration").alias("average_duration"),
            F.stddev("next_fare_duration").alias("deviation_duration"),
        )
        .orderBy("average_duration", "dropoff_borough")
    )


def quantile_classes(stats: DataFrame, value: str, k: int = 5) -> DataFrame:
    """``class`` from 0: the first of k quantiles the value does not exceed.
    Equal quantiles count as one.

    One row per region meets in one window here, a report's worth of rows.
    """
    shares = F.array(*[F.lit((i + 1) / k) for i in range(k)])
    bounds = F.percentile(value, shares).over(Window.partitionBy(F.lit(1)))
    below = F.filter(F.array_distinct("_bounds"), lambda b: b < F.col(value))
    return stats.withColumn("_bounds", bounds).withColumn("class", F.size(below)).drop("_bounds")


def features(classes: DataFrame, polygons: DataFrame, region: str, by: str = "borough") -> DataFrame:
    """One GeoJSON feature per region: its ``polygons`` as the geometry and the columns
    of ``classes`` as properties."""
    shapes = polygons.withColumnRenamed("polygons", "_coordinates")
    geometry = F.struct(
        F.lit("MultiPolygon").alias("type"), F.col("_coordinates").alias("coordinates")
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*classes.columns).alias("properties"),
        geometry.alias("geometry"),
    )
    return classes.join(shapes, classes[region].eqNullSafe(shapes[by])).select(
        F.col(region), F.to_json(feature).alias("feature")
    )
