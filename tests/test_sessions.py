"""Pairing of consecutive trips, against a sort in plain Python."""

import random
from itertools import groupby

import pytest

from curbwait.operators import next_fare as nf
from curbwait.schemas import TRIP_COLUMNS

SCHEMA = (
    "hack_license string, pickup_datetime bigint, dropoff_datetime bigint, "
    "pickup_longitude double, pickup_latitude double, "
    "dropoff_longitude double, dropoff_latitude double"
)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def trip(driver, pickup, dropoff, place=0.0):
    return (driver, pickup, dropoff, place, place + 1, place + 2, place + 3)


def paired(rows):
    """Every trip with the next pick-up's time and place and the gap."""
    found = []
    key = lambda r: (r[0] is not None, r[0] or "")
    for _, trips in groupby(sorted(rows, key=lambda r: (key(r), r[1:])), key=key):
        trips = list(trips)
        for this, following in zip(trips, [*trips[1:], None]):
            lead = (None,) * 4
            if following:
                lead = following[1], following[3], following[4], following[1] - this[2]
            found.append((*this, *lead))
    return sorted(found, key=repr)


def spark_paired(df):
    columns = [*TRIP_COLUMNS, "lead_pickup_datetime", "lead_pickup_longitude",
               "lead_pickup_latitude", "next_fare_duration"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


CASES = [
    trip("a", 0, 60), trip("a", 120, 180, 1.0), trip("a", 180, 400, 2.0), trip("a", 300, 350, 3.0),
    trip("b", 50, 60, 4.0),
    trip("c", 10, 40, 5.0), trip("c", 10, 30, 6.0), trip("c", 10, 30, 5.5), trip("c", 100, 110),
]


def test_gaps_of_every_kind(spark):
    gaps = nf.next_fare(table(spark, CASES))
    assert spark_paired(gaps) == paired(CASES)
    counts = nf.gap_quality(gaps).first()
    assert tuple(counts) == (3, 3, 1, 2)
    assert nf.positive_gaps(gaps).count() == 2


def test_times_come_back_as_timestamps(spark):
    row = nf.positive_gaps(nf.next_fare(table(spark, CASES))).where("hack_license = 'a'").first()
    assert str(row.dropoff_datetime) == "1970-01-01 00:01:00"
    assert row.next_fare_duration == 60


@pytest.mark.parametrize("seconds", [1, 40, 700, 100_000])
def test_hot_drivers_are_paired_slice_by_slice(spark, seconds):
    """One driver has most trips, of those a third at one second and a third
    copies of one trip; another one has no name."""
    random.seed(seconds)
    rows = [trip("hot", random.randrange(5000), random.randrange(5000), random.random()) for _ in range(300)]
    rows += [trip("hot", 2500, random.randrange(3000), random.random()) for _ in range(300)]
    rows += [trip("hot", 2600, 2700, 0.5)] * 300
    rows += [trip(f"d{random.randrange(30)}", random.randrange(9000), random.randrange(9000)) for _ in range(300)]
    rows += [trip(None, random.randrange(5000), 1, random.random()) for _ in range(200)]
    random.shuffle(rows)
    gaps = nf.next_fare(table(spark, rows).repartition(7), seconds)
    assert spark_paired(gaps) == paired(rows)


def test_layout_keeps_slices_together_and_in_order(spark):
    random.seed(1)
    rows = [trip(f"d{random.randrange(9)}", random.randrange(900), 0, random.random()) for _ in range(2000)]
    parts = nf.sessions_layout(table(spark, rows), 100).select("hack_license", "slice", "pickup_datetime").rdd.glom()
    seen = set()
    for part in parts.collect():
        assert [tuple(r) for r in part] == sorted(tuple(r) for r in part)
        own = {(r[0], r[1]) for r in part}
        assert not own & seen
        seen |= own
    assert len(seen) == 81


def test_pairing_uses_the_shuffle_of_the_layout(spark):
    rows = nf.next_fare(table(spark, CASES))
    text = rows._jdf.queryExecution().executedPlan().toString()
    own = [line for line in text.splitlines() if "Exchange hashpartitioning(hack_license" in line]
    assert sum("REPARTITION_BY_COL" in line for line in own) == 1
    # the others move one row for each slice
    assert len(own) <= 3
