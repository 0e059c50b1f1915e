"""Each trip with its driver's next one."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbwait.schemas import DRIVER, NEXT_PICKUP, PICKUP, TRIP_ORDER

SLICE_SECONDS = 86_400
_LEADS = ("lead_pickup_datetime", *NEXT_PICKUP)


def sessions_layout(
    trips: DataFrame, seconds: int = SLICE_SECONDS, order: Sequence[str] = TRIP_ORDER
) -> DataFrame:
    """Trips with ``slice``, the day or other span of the pick-up, laid out so that each
    driver's trips of a slice are in one partition, together and in order.

    Slices cut drivers with very many trips, such as a placeholder licence, as the
    data are; what a task must hold is a driver's trips of one slice.
    """
    return with_slice(trips, seconds).repartition(DRIVER, "slice").sortWithinPartitions(DRIVER, "slice", *order)


def next_fare(
    trips: DataFrame, seconds: int = SLICE_SECONDS, order: Sequence[str] = TRIP_ORDER
) -> DataFrame:
    """Every trip with ``lead_pickup_datetime``, ``lead_pickup_longitude`` and
    ``lead_pickup_latitude`` of the driver's next trip, and the seconds between
    this drop-off and that pick-up as ``next_fare_duration``; null for a driver's
    last trip. ``order`` begins with the pick-up time.

    All drivers are cut into slices of time. Within a slice a window pairs the trips,
    on the layout's own shuffle. The last trip of a slice is followed by the first one
    of the driver's next slice: those, one row per slice, combined before they are
    shuffled, are paired by a window of their own and joined.
    """
    led = led_in_slices(sessions_layout(trips, seconds, order), order)
    return stitched(led, turns(firsts(with_slice(trips, seconds), order)))


def with_slice(trips: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    return trips.withColumn("slice", F.floor(F.col("pickup_datetime") / seconds))


def led_in_slices(sliced: DataFrame, order: Sequence[str] = TRIP_ORDER) -> DataFrame:
    """Trips with the columns of the driver's next one in the same slice."""
    window = Window.partitionBy(DRIVER, "slice").orderBy(*order)
    return sliced.withColumns(
        {name: F.lead(c).over(window) for name, c in zip(_LEADS, ("pickup_datetime", *PICKUP), strict=True)}
    )


def firsts(sliced: DataFrame, order: Sequence[str] = TRIP_ORDER) -> DataFrame:
    """A driver's first trip of each slice, as the struct ``first``."""
    return sliced.groupBy(DRIVER, "slice").agg(F.min(F.struct(*order)).alias("first"))


def turns(first_trips: DataFrame) -> DataFrame:
    """For each driver's slice the first trip of the next one, ``_next``."""
    onward = F.lead("first").over(Window.partitionBy(DRIVER).orderBy("slice"))
    return first_trips.select(F.col(DRIVER).alias("_driver"), F.col("slice").alias("_slice"), onward.alias("_next"))


def stitched(led: DataFrame, following: DataFrame, null_safe: bool = True) -> DataFrame:
    """Trips led in their slices, the last of each with the first of the driver's next
    slice, and the gaps; without ``slice``."""
    if null_safe:
        same = led[DRIVER].eqNullSafe(following["_driver"]) & led["slice"].eqNullSafe(following["_slice"])
    else:
        same = (led[DRIVER] == following["_driver"]) & (led["slice"] == following["_slice"])
    last = F.col("lead_pickup_datetime").isNull()
    columns = {
        name: F.when(last, F.col(f"_next.{c}")).otherwise(F.col(name))
        for name, c in zip(_LEADS, ("pickup_datetime", *PICKUP), strict=True)
    }
    joined = led.join(following, same, "left").withColumns(columns)
    return _gap(joined.drop("slice", "_driver", "_slice", "_next"))


def _gap(trips: DataFrame) -> DataFrame:
    seconds = F.col("lead_pickup_datetime") - F.col("dropoff_datetime")
    return trips.withColumn("next_fare_duration", seconds)


def gap_quality(gaps: DataFrame) -> DataFrame:
    """Trips without a next one, and gaps below, at and above zero, in one pass."""
    gap = F.col("next_fare_duration")
    return gaps.agg(
        F.count_if(gap.isNull()).alias("last_trips"),
        F.count_if(gap < 0).alias("negative_gaps"),
        F.count_if(gap == 0).alias("zero_gaps"),
        F.count_if(gap > 0).alias("positive_gaps"),
    )


def positive_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps above zero, times as timestamps again."""
    return (
        gaps.where("next_fare_duration > 0")
        .drop("lead_pickup_datetime")
        .withColumns(
            {
                "pickup_datetime": F.col("pickup_datetime").cast("timestamp"),
                "dropoff_datetime": F.col("dropoff_datetime").cast("timestamp"),
            }
        )
    )
