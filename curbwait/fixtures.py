"""Trips and zones derived from the star-schema test tables by formula.

A user is a driver, an event a trip, a nation a zone and a region a borough.
Coordinates run past the zone grid, so that some trips end outside.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbwait.functions.times import epoch_seconds
from curbwait.schemas import DROPOFF, PICKUP


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trips(spark: SparkSession, folder: str) -> DataFrame:
    pickup = epoch_seconds("ts")

    def place(step, around):
        return f"((event_id * {step}) % {around} + 0.5D) / 1000"

    return table(spark, folder, "events").selectExpr(
        "event_id as trip_id",
        "user_id as hack_license",
        f"{pickup} as pickup_datetime",
        f"{pickup} + cast(round(value * 100) as bigint) - 120 as dropoff_datetime",
        f"{place(7919, 5600)} as pickup_longitude",
        f"{place(10473, 5300)} as pickup_latitude",
        f"{place(6007, 5600)} as dropoff_longitude",
        f"{place(3571, 5300)} as dropoff_latitude",
    )


def trips_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The trips as timestamps, with gaps: null and NaN in some rows."""
    return trips(spark, folder).selectExpr(
        "trip_id",
        "hack_license",
        "cast(pickup_datetime as timestamp) as pickup_datetime",
        "if(trip_id % 101 = 0, null, cast(dropoff_datetime as timestamp)) as dropoff_datetime",
        "if(trip_id % 97 = 0, null, pickup_longitude) as pickup_longitude",
        "pickup_latitude",
        "dropoff_longitude",
        "if(trip_id % 103 = 0, double('NaN'), dropoff_latitude) as dropoff_latitude",
    )


def trip_file_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The trips with all columns of a trip file."""
    return trips(spark, folder).selectExpr(
        "string(trip_id) as medallion",
        "string(hack_license) as hack_license",
        "'V' as vendor_id",
        "'1' as rate_code",
        "'N' as store_and_fwd_flag",
        "cast(pickup_datetime as timestamp) as pickup_datetime",
        "cast(dropoff_datetime as timestamp) as dropoff_datetime",
        "'1' as passenger_count",
        "string(dropoff_datetime - pickup_datetime) as trip_time_in_secs",
        "pickup_longitude as trip_distance",
        *PICKUP,
        *DROPOFF,
    )


def zones(spark: SparkSession, folder: str, taller: Sequence[str] = ()) -> DataFrame:
    """Cell (c, r) of a grid per nation: c its region, r its number over five.

    Corners are moved by a function of their own place, so neighbours share them. Zones
    of regions named in ``taller`` reach half a cell up, over the next one of the region.
    """
    region = table(spark, folder, "region")
    cells = (
        table(spark, folder, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr("n_name as zone", "r_name as borough", "n_regionkey as c", "n_nationkey div 5 as r")
        .withColumn("up", F.when(F.col("borough").isin(list(taller)), 0.5).otherwise(0.0))
    )

    def corner(i, j):
        x = f"c + {i} + (((c + {i}) * 3 + (r + {j}) * 5) % 3 - 1) * 0.125D"
        y = f"r + {j} + (((c + {i}) * 5 + (r + {j}) * 2) % 3 - 1) * 0.125D + {j} * up"
        return f"concat_ws(' ', string({x}), string({y}))"

    corners = [corner(i, j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    ring = f"concat_ws(', ', {', '.join(corners)})"
    return cells.selectExpr(
        "zone", "borough", f"concat('MULTIPOLYGON (((', {ring}, ')))') as the_geom"
    )


def tall_zones(spark: SparkSession, folder: str) -> DataFrame:
    """A thin triangle per nation, side by side, each as tall as all of them."""
    region = table(spark, folder, "region")
    nations = table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    left = "n_nationkey * 0.21875D"
    ring = [(left, 0), (f"{left} + 0.1875D", 0), (f"{left} + 0.09375D", 5), (left, 0)]
    text = ", ', ', ".join(f"string({x}), ' {y}'" for x, y in ring)
    return nations.selectExpr("n_name as zone", "r_name as borough", f"concat('POLYGON ((', {text}, '))') as the_geom")


def vast_zones(spark: SparkSession, folder: str) -> DataFrame:
    """A triangle per region with corners of 52 bits, all from the same corner."""
    ring = [("0", "0"), ("4503599627370495 - 1000003 * r_regionkey", "2251799813685249 + 77777 * r_regionkey"), ("0", "4503599627370495"), ("0", "0")]
    text = ", ', ', ".join(f"string({x}), ' ', string({y})" for x, y in ring)
    return table(spark, folder, "region").selectExpr(
        "r_name as zone", "r_name as borough", f"concat('POLYGON ((', {text}, '))') as the_geom"
    )


def border_places(spark: SparkSession, folder: str) -> DataFrame:
    """A place per event on the lower border of one of the triangles, cut to whole
    numbers, or one above or below it."""
    return table(spark, folder, "events").selectExpr(
        "event_id as place_id",
        "double((4503599627370495 - 1000003 * (event_id % 5)) * (event_id % 1000) div 1000) as x",
        "double((2251799813685249 + 77777 * (event_id % 5)) * (event_id % 1000) div 1000 + event_id div 5 % 3 - 1) as y",
    )


def split_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zones, those in odd rows cut in two from the middle of their lower border to
    that of the upper one, so that the rows' vertices do not match."""
    text = F.col("the_geom")
    corners = F.transform(
        F.slice(F.split(F.regexp_replace(text, r"[^0-9.,E -]|^ ", ""), ","), 1, 4),
        lambda pair: F.transform(F.split(F.trim(pair), " "), lambda n: n.cast("double")),
    )
    placed = zones(spark, folder).join(table(spark, folder, "nation"), F.col("zone") == F.col("n_name"))
    whole = placed.select("zone", "borough", "the_geom", F.expr("n_nationkey div 5").alias("r"), corners.alias("v"))

    def between(i, j):
        return f"array((v[{i}][0] + v[{j}][0]) / 2, (v[{i}][1] + v[{j}][1]) / 2)"

    def shape(*spots):
        ring = ", ', ', ".join(f"concat_ws(' ', string({s}[0]), string({s}[1]))" for s in (*spots, spots[0]))
        return f"concat('POLYGON ((', {ring}, '))')"

    low, high = between(0, 1), between(3, 2)
    left, right = shape("v[0]", low, high, "v[3]"), shape(low, "v[1]", "v[2]", high)
    return whole.selectExpr(
        "borough",
        f"""inline(if(r % 2 = 0, array(struct(zone, the_geom)),
            array(struct(zone || ' left' as zone, {left} as the_geom), struct(zone || ' right' as zone, {right} as the_geom))))""",
    ).select("zone", "borough", "the_geom")


def jagged_edges(spark: SparkSession, folder: str, n: int = 4000) -> DataFrame:
    """One ring of ``n`` jagged edges around a point for each region, as edges."""

    def corner(k):
        reach = f"(0.3D + ((({k}) * 7919 + r_regionkey * 1049) % 1000) / 5000.0D)"
        turn = f"(2 * pi() * ({k}) / {n})"
        return (
            f"round(r_regionkey + 0.5D + {reach} * cos{turn}, 9)",
            f"round(2.5D + 5 * {reach} * sin{turn}, 9)",
        )

    corners = table(spark, folder, "region").selectExpr(
        "r_name as zone", "r_name as borough", "r_regionkey", f"explode(sequence(0, {n - 1})) as k"
    )
    (x1, y1), (x2, y2) = corner("k"), corner(f"(k + 1) % {n}")
    return corners.selectExpr("zone", "borough", f"{x1} as x1", f"{y1} as y1", f"{x2} as x2", f"{y2} as y2")


def mixed_zones(spark: SparkSession, folder: str) -> DataFrame:
    """A zone per nation, of six kinds in turn by its number: with a hole, of two parts,
    one polygon, empty, of three dimensions, and with a ring that is not closed."""
    region = table(spark, folder, "region")
    cells = table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    def ring(low, high, last=True):
        turns = [(low, low), (high, low), (high, high), (low, high)] + [(low, low)] * last
        return ", ', ', ".join(f"string(c + {i}D), ' ', string(r + {j}D)" for i, j in turns)

    square = ring(0, 1)
    shapes = [
        f"concat('MULTIPOLYGON (((', {square}, '), (', {ring(0.25, 0.75)}, ')))')",
        f"concat('MULTIPOLYGON (((', {ring(0, 0.5)}, ')), ((', {ring(0.75, 1)}, ')))')",
        f"concat('POLYGON ((', {square}, '))')",
        "'MULTIPOLYGON EMPTY'",
        f"concat('POLYGON Z ((', {square}, '))')",
        f"concat('POLYGON ((', {ring(0, 1, last=False)}, '))')",
    ]
    kinds = " ".join(f"when {k} then {shape}" for k, shape in enumerate(shapes))
    placed = cells.selectExpr("n_name as zone", "r_name as borough", "n_nationkey * 2D as c", "n_regionkey * 2D as r", "n_nationkey % 6 as kind")
    return placed.selectExpr("zone", "borough", f"case kind {kinds} end as the_geom")
