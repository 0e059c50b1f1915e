"""The whole analysis, from the two files to every result, as written tables."""

from pyspark.sql import DataFrame, SparkSession

from curbwait.operators import next_fare, regions, trips, zones
from curbwait.operators.coverage import overlaps
from curbwait.operators.grid import fit_grid
from curbwait.operators.locate import build_index
from curbwait.operators.union import union_areas
from curbwait.plans import jobs
from curbwait.session import kept
from curbwait.sources import csv, sinks


def analyse(
    spark: SparkSession,
    trips_path: str,
    zones_path: str,
    out: str,
    service_area_only: bool = False,
) -> DataFrame:
    """Write all results below ``out`` and return the idle time by region.

    Tables that several results are made from are written once and read back:
    clean trips, the zones' edges, and trips paired with the next one. ``service_area_only`` leaves
    out trips that end in no region before drivers' trips are paired.
    """

    def saved(df: DataFrame, name: str) -> DataFrame:
        sinks.write_table(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    clean = saved(trips.clean_trips(csv.read_trips(spark, trips_path)), "trips")
    sinks.write_table(trips.summary(clean), f"{out}/summary")
    sinks.write_table(trips.hours_histogram(clean), f"{out}/hours")
    sinks.write_table(trips.hours_quantiles(clean, error=0.01), f"{out}/hours_quantiles")
    likely = trips.plausible(clean).drop("trip_in_hours")

    zone_table = csv.read_zones(spark, zones_path)
    sinks.write_table(zones.rejected_zones(zone_table), f"{out}/rejected_zones")
    edges = saved(zones.zones_to_edges(zone_table), "edges")
    index = build_index(edges)
    sinks.write_table(overlaps(edges, fit_grid(edges, "borough")[0]), f"{out}/overlaps")
    sinks.write_table(union_areas(edges), f"{out}/regions")
    with kept(likely) as likely:  # read twice or three times
        ends = saved(jobs.dropoff_distribution(likely, index), "dropoffs")
        unknown = regions.unknown_regions(ends, zone_table)
        sinks.write_table(unknown, f"{out}/unknown_regions")

        served = likely
        if service_area_only:
            flagged = saved(jobs.by_service_area(likely, index), "served_trips")
            served = flagged.where("in_service_area").drop("in_service_area")
        paired = saved(next_fare.next_fare(served), "paired_trips")
    sinks.write_table(next_fare.gap_quality(paired), f"{out}/gap_quality")
    od = saved(jobs.od_gaps(next_fare.positive_gaps(paired), index), "idle_trips")
    idle = saved(regions.idle_by_region(od), "idle_by_region")
    sinks.write_features(jobs.choropleth_of_edges(idle, edges), f"{out}/map")
    return idle
