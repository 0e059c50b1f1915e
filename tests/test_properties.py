"""What must hold of the derived trips and zones, whatever their values."""

import pytest
from pyspark.sql import functions as F

from curbwait import fixtures
from curbwait.operators import next_fare, trips, zones
from curbwait.operators.locate import build_index, inside, locate, outside, regions_at
from curbwait.schemas import DROPOFF

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def edges(spark):
    return zones.zones_to_edges(fixtures.zones(spark, FOLDER))


@pytest.fixture(scope="module")
def index(edges):
    return build_index(edges)


def test_inside_and_outside_are_all_trips(spark, index):
    rows = fixtures.trips(spark, FOLDER)
    parts = inside(rows, *DROPOFF, index).union(outside(rows, *DROPOFF, index))
    assert parts.count() == rows.count()
    assert parts.exceptAll(rows).isEmpty()


def test_regions_hold_what_their_zones_hold(spark, edges, index):
    rows = fixtures.trips(spark, FOLDER).select("trip_id", *DROPOFF)
    by_region = locate(rows, *DROPOFF, index).select("trip_id", "borough")
    zones_of = edges.select("zone", "borough").distinct()
    by_zone = locate(rows, *DROPOFF, build_index(edges, "zone")).join(zones_of, "zone").select("trip_id", "borough")
    assert by_zone.exceptAll(by_region).isEmpty()
    # what no single zone holds lies on a border between two of a region
    assert by_region.count() - by_zone.count() <= 5


def test_a_point_is_in_one_region_at_most(spark, index):
    found = regions_at(fixtures.trips(spark, FOLDER), *DROPOFF, index)
    assert found.where("size(regions) > 1").isEmpty()


def test_areas_of_regions_add_up_to_those_of_zones(edges):
    def total(df):
        return df.agg(F.sum("location_area")).first()[0]

    whole = total(zones.area(zones.dissolve(edges), "borough"))
    assert whole == pytest.approx(total(zones.area(edges, "zone")))


def test_every_trip_but_the_last_has_a_gap(spark):
    likely = trips.plausible(fixtures.trips(spark, FOLDER)).drop("trip_in_hours")
    counts = next_fare.gap_quality(next_fare.next_fare(likely)).first()
    assert counts.last_trips == likely.select("hack_license").distinct().count()
    assert sum(counts) == likely.count()


@pytest.mark.parametrize("seconds", [3600, 10**12])
def test_slices_change_nothing(spark, seconds):
    likely = trips.plausible(fixtures.trips(spark, FOLDER)).drop("trip_in_hours")
    plain = next_fare.next_fare(likely)
    sliced = next_fare.next_fare(likely, seconds)
    assert sliced.count() == plain.count()
    assert sliced.exceptAll(plain).isEmpty()
