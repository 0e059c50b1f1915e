"""How the lookup's cells grow and how evenly they are filled."""

import random

import pytest
from pyspark.sql import functions as F
from test_geometry import exactly_inside, where
from test_plans import plan

from curbwait import fixtures
from curbwait.operators.cells import by_band, fit_bands
from curbwait.operators.grid import upward
from curbwait.operators.locate import build_index, locate

FOLDER = "/root/testdata/sf0.001"
EDGES = "zone string, borough string, x1 double, y1 double, x2 double, y2 double"


def ring_edges(spark, *rings):
    """Edges of rings given as (region, corners), inside on the left."""
    rows = []
    for k, (region, ring) in enumerate(rings):
        rows += [(f"z{k}", region, *map(float, a), *map(float, b)) for a, b in zip(ring, [*ring[1:], ring[0]])]
    return spark.createDataFrame(rows, EDGES)


def triangles(n, slant=0.0):
    """Thin triangles side by side, each as tall as all."""
    return [("ABC"[k % 3], [(k, 0), (k + 0.9, 0), (k + 0.45 + slant * n, 1000)]) for k in range(n)]


def entries(index):
    edges = F.expr("aggregate(_parts, 0, (n, p) -> n + size(p.edges))")
    return index.held.cells.agg(F.count("*"), F.sum(edges), F.max(edges)).first()


def test_tall_borders_grow_in_proportion(spark):
    sizes = {}
    for n in (250, 500, 1000):
        index = build_index(ring_edges(spark, *triangles(n)))
        sizes[n] = entries(index)
        rng = random.Random(n)
        points = [(rng.uniform(0, n), rng.uniform(0, 1000)) for _ in range(300)]
        wanted = []
        for x, y in points:
            near = [triangles(n)[k] for k in range(max(0, int(x) - 1), min(n, int(x) + 2))]
            wanted.append(sorted({r for r, ring in near if exactly_inside([[*ring, ring[0]]], x, y)}))
        assert where(spark, index, *points) == wanted
    for k in (0, 1):  # cells, and edges in them
        assert sizes[1000][k] < 2.5 * sizes[500][k] < 6.5 * sizes[250][k]
    assert sizes[1000][1] < 80 * 3000
    assert sizes[1000][2] <= 4 * sizes[250][2]


def test_a_dense_part_does_not_fill_a_band(spark):
    """Nine tenths of the edges in a hundredth of the extent."""
    rng = random.Random(1)
    rings = []
    for k in range(1500):
        span = 10 if k % 10 else 1000
        x, y = rng.uniform(0, span), rng.uniform(0, span)
        size = span / 100
        rings.append((f"r{k}", [(x, y), (x + size, y + rng.random() * size / 10), (x + size / 2, y + size)]))
    edges = upward(ring_edges(spark, *rings).selectExpr("*", "borough as region", "1L as net"), "region")
    bands = fit_bands(edges)[0]
    inside = by_band(edges, bands).selectExpr("band", "int(low < y1 and y1 < high) + int(low < y2 and y2 < high) as ends")
    held = sorted(r.n for r in inside.groupBy("band").agg(F.sum("ends").alias("n")).collect())
    assert len(held) > 100
    assert held[-1] <= 4 * max(held[len(held) // 2], 16)
    index = build_index(ring_edges(spark, *rings))
    assert entries(index)[2] < 200


def test_many_ends_at_one_height_are_a_limit(spark):
    rings = [("A", [(k, 0), (k + 0.9, 0), (k + 0.9, 1 + k % 3), (k, 1 + k % 3)]) for k in range(300)]
    edges = ring_edges(spark, *rings)
    bands = fit_bands(upward(edges.selectExpr("*", "borough as region", "1L as net"), "region"))[0]
    assert {0.0, 1.0, 2.0} <= set(bands.limits)
    points = [(0.5, 0.5), (0.5, 1.0), (1.5, 1.0), (1.5, 1.5), (0.95, 0.5), (2.0, 1.0), (2.5, 2.9), (2.5, 3.0)]
    wanted = [["A"], [], ["A"], ["A"], [], [], ["A"], []]
    assert where(spark, build_index(edges), *points) == wanted


@pytest.mark.parametrize("seed", range(3))
def test_slanted_and_crossing_rings(spark, seed):
    rng = random.Random(seed)
    rings = [
        (rng.choice("ABC"), [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(rng.randint(3, 6))]) for _ in range(14)
    ]
    points = [(rng.randint(-1, 26) / 2, rng.randint(-1, 26) / 2) for _ in range(250)]
    closed = {r: [[*ring, ring[0]] for name, ring in rings if name == r] for r in "ABC"}
    wanted = [sorted(r for r in "ABC" if closed[r] and exactly_inside(closed[r], x, y)) for x, y in points]
    edges = ring_edges(spark, *rings).where("x1 <> x2 or y1 <> y2")
    for index in (build_index(edges), build_index(edges, columns=3, bands=5), build_index(edges).shuffled()):
        assert where(spark, index, *points) == wanted


def test_jagged_borders_take_two_lookups(spark):
    index = build_index(fixtures.jagged_edges(spark, FOLDER, 800))
    cells, edges, most = entries(index)
    assert cells < 20 * 4000 and edges < 40 * 4000 and most < 60
    points = fixtures.trips(spark, FOLDER).select("trip_id", "dropoff_longitude", "dropoff_latitude")
    text = plan(locate(points, "dropoff_longitude", "dropoff_latitude", index))
    assert text.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in text


def test_a_busy_place_is_many_tasks(spark):
    """Equal points of several partitions get several salts where nothing is broadcast."""
    index = build_index(fixtures.jagged_edges(spark, FOLDER, 100)).shuffled()
    points = spark.range(0, 800, 1, 8).selectExpr("1.5D as x", "2.5D as y")
    assert locate(points, "x", "y", index).count() == 800
    salts = points.selectExpr("pmod(xxhash64(x, y, spark_partition_id()), 16) as s").distinct().count()
    assert salts > 3
