"""Cleaning and profiling of trips."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbwait.functions.geometry import point
from curbwait.functions.times import epoch_seconds, whole_hours
from curbwait.schemas import DROPOFF, PICKUP, TRIP_COLUMNS


def clean_trips(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The columns the analysis needs, rows with any of them missing dropped,
    times as epoch seconds. ``keep`` names further columns to carry along.
    """
    times = ("pickup_datetime", "dropoff_datetime")
    complete = raw.select(*keep, *TRIP_COLUMNS).dropna("any", subset=TRIP_COLUMNS)
    return complete.selectExpr(
        *[f"{epoch_seconds(c)} as {c}" if c in times else c for c in complete.columns]
    )


def with_points(trips: DataFrame) -> DataFrame:
    """Coordinate pairs as points. The jobs work on the bare pairs, which are
    narrower to shuffle; this is for whoever wants the points in a table.
    """
    others = [c for c in trips.columns if c not in (*PICKUP, *DROPOFF)]
    return trips.selectExpr(
        *others, f"{point(*PICKUP)} as pickup_point", f"{point(*DROPOFF)} as dropoff_point"
    )


def with_hours(trips: DataFrame) -> DataFrame:
    hours = whole_hours("pickup_datetime", "dropoff_datetime")
    return trips.selectExpr("*", f"{hours} as trip_in_hours")


def plausible(trips: DataFrame, lo: int = 0, hi: int = 4) -> DataFrame:
    """Trips of at least ``lo`` and less than ``hi`` whole hours."""
    return with_hours(trips).where(f"trip_in_hours >= {lo} and trip_in_hours < {hi}")


def hours_histogram(trips: DataFrame) -> DataFrame:
    return (
        with_hours(trips)
        .groupBy("trip_in_hours")
        .agg(F.count("*").alias("count"))
        .orderBy("trip_in_hours")
    )


def hours_quantiles(
    trips: DataFrame,
    probabilities: Sequence[float] = (0.25, 0.5, 0.75, 0.97),
    error: float = 0.0,
) -> DataFrame:
    """Quantiles of the trip hours, one row per probability.

    Exact ones are taken from the histogram, so what meets in one task is one
    row per distinct hour count. With ``error`` above zero the answer's rank may
    be off by that share of the rows, in one pass over a fixed-size summary.
    """
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    if error > 0:
        accuracy = F.lit(int(round(1 / error)))
        found = with_hours(trips).agg(
            F.percentile_approx("trip_in_hours", asked, accuracy).alias("found")
        )
    else:
        found = (
            with_hours(trips)
            .groupBy("trip_in_hours")
            .count()
            .agg(F.percentile("trip_in_hours", asked, F.col("count")).alias("found"))
        )
    pairs = F.explode(F.arrays_zip(asked.alias("probability"), F.col("found").alias("value")))
    return found.select(pairs.alias("pair")).select(
        "pair.probability", F.col("pair.value").cast("double").alias("value")
    )


def quantile_ranks(trips: DataFrame, quantiles: DataFrame) -> DataFrame:
    """For each quantile the rows below and up to its value, to judge an
    approximate answer by: a right one has ``below <= p * rows <= upto``.
    """
    histogram = with_hours(trips).groupBy("trip_in_hours").count()
    below = F.when(F.col("trip_in_hours") < F.col("value"), F.col("count")).otherwise(0)
    upto = F.when(F.col("trip_in_hours") <= F.col("value"), F.col("count")).otherwise(0)
    asked = quantiles.agg(
        F.collect_list(F.struct("probability", "value")).alias("asked")
    ).scalar()
    return (
        histogram.select("*", F.explode(asked).alias("q"))
        .select("trip_in_hours", "count", "q.probability", "q.value")
        .groupBy("probability", "value")
        .agg(
            F.sum(below).alias("below"),
            F.sum(upto).alias("upto"),
            F.sum("count").alias("rows"),
        )
    )


def summary(df: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, least and greatest value of each number or
    text column, one row per column, in one pass.

    Text that reads as a number counts into the mean. Least and greatest are
    given as text, as the columns differ in type.
    """
    described = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.StringType))
    ]
    rows = [
        f"""struct('{name}' as column_name, count(`{name}`) as count,
                   avg(try_cast(`{name}` as double)) as mean,
                   stddev(try_cast(`{name}` as double)) as stddev,
                   string(min(`{name}`)) as min, string(max(`{name}`)) as max)"""
        for name in described
    ]
    return df.selectExpr(f"array({', '.join(rows)}) as rows").selectExpr("inline(rows)")


def preview(df: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    """The first n rows by the given columns, the same rows every time."""
    return df.orderBy(*by).limit(n)
