"""What the plans of the main jobs must and must not contain."""

import pytest

from curbwait import fixtures
from curbwait.plans import jobs
from curbwait.schemas import DROPOFF

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark):
    return jobs.region_index(fixtures.zones(spark, FOLDER))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_locate_broadcasts_the_index_and_moves_no_points(spark, index):
    points = fixtures.trips(spark, FOLDER).select("trip_id", *DROPOFF)
    text = plan(jobs.dropoff_located(points, index))
    assert text.count("BroadcastHashJoin") == 2
    assert "Exchange hashpartitioning" not in text
    for bad in ("NestedLoop", "Cartesian", "Python"):
        assert bad not in text


def test_the_report_shuffles_trips_once_and_rows_of_regions(spark, index):
    text = plan(jobs.idle_report(fixtures.trips(spark, FOLDER), index))
    own = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    # the trips themselves, then one row for each slice by slice and by driver
    drivers = [line for line in own if "hashpartitioning(hack_license" in line]
    assert sum("REPARTITION_BY_COL" in line for line in drivers) == 1 and len(drivers) == 3
    assert sum("hashpartitioning(dropoff_borough" in line for line in own) == 1
    for bad in ("NestedLoop", "Cartesian", "Python"):
        assert bad not in text


def test_the_report_broadcasts_the_index_once(spark, index):
    text = final_plan(jobs.idle_report(fixtures.trips(spark, FOLDER), index))
    assert text.count("BroadcastHashJoin") in (4, 5)  # the index twice for each end; perhaps the slices
    assert text.count("ReusedExchange") == 2


def test_a_large_index_is_joined_by_shuffle(spark, index):
    points = fixtures.trips(spark, FOLDER).select("trip_id", *DROPOFF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(jobs.dropoff_located(points, index.shuffled()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "NestedLoop" not in text


def test_scans_read_only_what_is_asked(spark, index):
    counts = plan(jobs.dropoff_distribution(fixtures.trips(spark, FOLDER), index))
    assert "ReadSchema: struct<event_id:bigint>" in counts


def test_the_report_without_broadcasts_pairs_once_and_starts_no_job(spark, index):
    rows = fixtures.trips(spark, FOLDER)  # reads a schema
    jobs_so_far = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = set(jobs_so_far(None))
    text = plan(jobs.idle_report(rows, index.shuffled()))
    assert set(jobs_so_far(None)) == before
    # pairs in slices, and the first trips of slices
    assert text.count("Window [") == 2
    assert text.count("FileScan parquet") == 2 + 4  # trips, their first ones, and the index for each end
    for bad in ("NestedLoop", "Cartesian", "Python"):
        assert bad not in text
