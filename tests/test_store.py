"""Stored sessions, merged profiles, rejected rows and frames kept for a while."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from test_plans import final_plan, plan
from test_sessions import CASES, paired, spark_paired, table, trip
from test_tables import GOOD, HEADER, written

from curbwait.operators import next_fare as nf
from curbwait.operators import profiles, trips
from curbwait.operators.session_store import SessionFiles, next_fare_bucketed, store_bucketed
from curbwait.schemas import TRIP_COLUMNS
from curbwait.session import kept
from curbwait.sources import csv

DAY = 86_400


def made(rng, n, drivers=4, days=5):
    rows = []
    for _ in range(n):
        pickup = rng.randrange(days * DAY)
        rows.append(trip(rng.choice("abcdefgh"[:drivers]), pickup, pickup + rng.randrange(9000), rng.randrange(50) / 8))
    return rows + rows[:5]


def test_bucketed_pairs_are_those_of_next_fare(spark, tmp_path):
    rows = [*CASES, *made(random.Random(1), 300)]
    name = f"sessions_{uuid.uuid4().hex}"
    store_bucketed(table(spark, rows), name, str(tmp_path), buckets=4)
    found = next_fare_bucketed(spark, name)
    assert spark_paired(found) == paired(rows)


def test_bucketed_pairing_moves_nothing(spark, tmp_path):
    name = f"sessions_{uuid.uuid4().hex}"
    store_bucketed(table(spark, made(random.Random(2), 100)), name, str(tmp_path), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = final_plan(next_fare_bucketed(spark, name))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" in text and "SortMergeJoin" in text
    assert "Exchange" not in text


@pytest.mark.parametrize("seed", [3, 4])
def test_appended_files_are_paired_as_one(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [*CASES, *made(rng, 200)]
    rng.shuffle(rows)
    files = SessionFiles(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        files.next_fare()
    held = []
    for part in (rows[:80], [], rows[80:90], [r for r in rows[90:] if r[1] < DAY], [r for r in rows[90:] if r[1] >= DAY]):
        files.append(table(spark, part))
        held += part
        if held:
            assert spark_paired(files.next_fare()) == paired(held)
    # another session finds what is in the folder
    again = SessionFiles(spark, str(tmp_path / "store"))
    assert spark_paired(again.next_fare()) == paired(rows)


def test_an_append_reads_only_the_slices_it_touches(spark, tmp_path):
    files = SessionFiles(spark, str(tmp_path))
    files.append(table(spark, [trip("a", k * DAY, k * DAY + 60) for k in range(9)]))
    text = plan(files.touched(table(spark, [trip("a", 3 * DAY + 100, 3 * DAY + 160), trip("b", 20 * DAY, 20 * DAY + 9)])))
    assert text.count("FileScan parquet") == 1
    assert "InMemoryFileIndex(1 paths)" in text and "slice=8" not in text


def test_profiles_of_parts_are_that_of_all(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, float("nan"), 1e9 + rng.random()]), rng.randrange(-9, 9), "x") for _ in range(500)]
    schema = "far double, small int, name string"
    parts = [rows[:3], [], rows[3:200], rows[200:]]
    state = profiles.merged([profiles.profile_state(spark.createDataFrame(p, schema)) for p in parts])
    whole = spark.createDataFrame(rows, schema).withColumn("far", F.nanvl("far", F.lit(None)))
    wanted = {r.column_name: r for r in trips.summary(whole).collect()}
    found = {r.column_name: r for r in profiles.described(state).collect()}
    assert set(found) == {"far", "small"}
    for name, r in found.items():
        assert r["count"] == wanted[name]["count"]
        assert r.mean == pytest.approx(wanted[name].mean, rel=1e-12)
        assert r.stddev == pytest.approx(wanted[name].stddev, rel=1e-6)
        assert (r.min, r.max) == (float(wanted[name].min), float(wanted[name].max))


def test_merged_sketches_keep_their_ranks(spark):
    rng = random.Random(6)
    values = [rng.gauss(0, 1) for _ in range(20_000)]
    frames = [spark.createDataFrame([(v,) for v in values[k::7]], "v double") for k in range(7)]
    state = profiles.merged([profiles.profile_state(f) for f in frames])
    for r in profiles.quantiles(state, [0.01, 0.3, 0.5, 0.99]).collect():
        assert abs(sum(v <= r.value for v in values) / len(values) - r.probability) < 0.02


def test_a_profile_of_nothing(spark):
    state = profiles.merged(profiles.profile_state(spark.createDataFrame([], "v double, w int")))
    assert {(r["column_name"], r["count"], r["mean"]) for r in profiles.described(state).collect()} == {("v", 0, None), ("w", 0, None)}
    assert profiles.quantiles(state, [0.5]).collect() == []


def test_rejected_rows_and_clean_ones_are_all(spark, tmp_path):
    lines = {
        GOOD: None,
        GOOD.replace("2013-01-01 15:11:48", "yesterday"): "bad pickup_datetime",
        "m,h,V,1,N,2013-01-01 15:11:48": "short line",
        GOOD + ",more,fields": None,
        GOOD.replace("40.75", ""): "missing pickup_latitude",
        GOOD.replace("40.75", "NaN"): "missing pickup_latitude",
        GOOD.replace("-73.98", "west"): "bad dropoff_longitude",
        GOOD.replace("382,1.0", "382,far"): None,
        GOOD.replace("m,h,V", 'm,"h, jr",V').replace("-73.98", "west"): "bad dropoff_longitude",
        GOOD.replace("m,h,V", "m,,V"): "missing hack_license",
    }
    path = written(tmp_path, HEADER, *lines)
    rows = csv.read_trips_checked(spark, path)
    rejected = csv.rejected_trips(rows)
    reasons = sorted(r.reason for r in rejected.collect())
    assert reasons == sorted(filter(None, lines.values()))
    assert trips.clean_trips(rows).count() + rejected.count() == rows.count() == len(lines)
    assert trips.clean_trips(rows).exceptAll(trips.clean_trips(csv.read_trips(spark, path))).isEmpty()
    broken = {r.line for r in rejected.where("line is not null").collect()}
    assert "m,h,V,1,N,2013-01-01 15:11:48" in broken


def test_frames_are_kept_within_their_scope(spark):
    rows = table(spark, CASES)
    with kept(nf.next_fare(rows)) as gaps:
        assert "InMemoryTableScan" in plan(gaps.select(TRIP_COLUMNS))
        assert gaps.count() == len(CASES)
        assert not gaps.storageLevel.useMemory and gaps.storageLevel.useDisk
    assert "InMemory" not in plan(nf.next_fare(rows).select(TRIP_COLUMNS))
    with pytest.raises(ZeroDivisionError), kept(rows) as held:
        1 // 0
    assert not held.storageLevel.useDisk
