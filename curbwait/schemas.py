"""Table schemas and the column names the jobs agree on."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The trip file's header, in order, with the type of each field.
TRIP_SCHEMA = StructType(
    [
        StructField("medallion", StringType()),
        StructField("hack_license", StringType()),
        StructField("vendor_id", StringType()),
        StructField("rate_code", StringType()),
        StructField("store_and_fwd_flag", StringType()),
        StructField("pickup_datetime", TimestampType()),
        StructField("dropoff_datetime", TimestampType()),
        StructField("passenger_count", StringType()),
        StructField("trip_time_in_secs", StringType()),
        StructField("trip_distance", DoubleType()),
        StructField("pickup_longitude", DoubleType()),
        StructField("pickup_latitude", DoubleType()),
        StructField("dropoff_longitude", DoubleType()),
        StructField("dropoff_latitude", DoubleType()),
    ]
)

ZONE_SCHEMA = StructType(
    [
        StructField("Shape_Leng", DoubleType()),
        StructField("the_geom", StringType()),
        StructField("Shape_Area", DoubleType()),
        StructField("zone", StringType()),
        StructField("borough", StringType()),
    ]
)

BOROUGH_SCHEMA = StructType(
    [
        StructField("BoroCode", IntegerType()),
        StructField("BoroName", StringType()),
        StructField("the_geom", StringType()),
        StructField("Shape_Leng", DoubleType()),
        StructField("Shape_Area", DoubleType()),
    ]
)

DRIVER = "hack_license"
PICKUP = ("pickup_longitude", "pickup_latitude")
DROPOFF = ("dropoff_longitude", "dropoff_latitude")
NEXT_PICKUP = ("lead_pickup_longitude", "lead_pickup_latitude")

TRIP_COLUMNS = [DRIVER, "pickup_datetime", "dropoff_datetime", *PICKUP, *DROPOFF]

# A driver's trips run by pick-up time; equal pick-ups by the rest of the row.
TRIP_ORDER = ["pickup_datetime", "dropoff_datetime", *PICKUP, *DROPOFF]
