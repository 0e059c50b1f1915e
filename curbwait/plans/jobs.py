"""The jobs a user calls, composed of the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.functions.times import whole_minutes
from curbwait.operators import next_fare, regions, trips, zones
from curbwait.operators.locate import RegionIndex, build_index, flagged, locate
from curbwait.operators.rings import region_polygons
from curbwait.operators.simplify import simplified
from curbwait.operators.union import union_edges
from curbwait.schemas import DROPOFF, NEXT_PICKUP


def region_index(zone_table: DataFrame, by: str = "borough", **options) -> RegionIndex:
    """Index the regions of a zone table."""
    return build_index(zones.zones_to_edges(zone_table), by, **options)


def dropoff_located(trip_table: DataFrame, index: RegionIndex) -> DataFrame:
    return locate(trip_table, *DROPOFF, index)


def dropoff_distribution(trip_table: DataFrame, index: RegionIndex) -> DataFrame:
    points = trip_table.select(*DROPOFF)
    return regions.distribution(locate(points, *DROPOFF, index), index.by)


def by_service_area(trip_table: DataFrame, index: RegionIndex) -> DataFrame:
    """Trips with ``in_service_area``: do they end in some region? One lookup; the
    caller filters."""
    return flagged(trip_table, *DROPOFF, index)


def od_gaps(gaps: DataFrame, index: RegionIndex) -> DataFrame:
    """Whole minutes to the next fare, with the regions of this drop-off and of
    the next pick-up; only where both lie in a region."""
    picked_up = locate(gaps, *NEXT_PICKUP, index, "next_pickup_borough")
    both = locate(picked_up, *DROPOFF, index, "dropoff_borough")
    minutes = F.expr(whole_minutes("next_fare_duration"))
    return both.withColumn("next_fare_duration", minutes)


def idle_report(trip_table: DataFrame, index: RegionIndex, **options) -> DataFrame:
    """From clean trips to idle time by drop-off region."""
    paired = next_fare.next_fare(trips.plausible(trip_table).drop("trip_in_hours"), **options)
    return regions.idle_by_region(od_gaps(next_fare.positive_gaps(paired), index))


def choropleth(stats: DataFrame, zone_table: DataFrame, k: int = 5) -> DataFrame:
    """The idle report as map features, coloured by classes of the mean: the outlines
    of the regions, without the borders between their zones."""
    return choropleth_of_edges(stats, zones.zones_to_edges(zone_table), k)


def choropleth_of_edges(stats: DataFrame, edges: DataFrame, k: int = 5, area: float | None = None) -> DataFrame:
    """The same from the zones' edges; with ``area``, outlines are simplified to it."""
    classes = regions.quantile_classes(stats, "average_duration", k)
    borders = union_edges(edges)
    outlines = region_polygons(borders if area is None else simplified(borders, area))
    return regions.features(classes, outlines, "dropoff_borough")
