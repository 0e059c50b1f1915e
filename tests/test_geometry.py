"""Hand-computed shapes, and the lookup against exact arithmetic."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from curbwait.operators import zones
from curbwait.operators.coverage import overlaps
from curbwait.operators.grid import fit_grid
from curbwait.operators.rings import region_polygons
from curbwait.operators.locate import build_index, inside, locate, outside, regions_at

SQUARE = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
BACKWARD = "POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))"
TRIANGLE = "MULTIPOLYGON (((0 0, 4 0, 0 2, 0 0)))"
ELL = "POLYGON((0 0,3 0,3 1,1 1,1 3,0 3,0 0))"
HOLED = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1)))"
TWO_PARTS = "multipolygon (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))"
EXPONENTS = "POLYGON ((0e0 0, 1E0 0, 1.0e+0 1, .0 10e-1, 0 0))"


def zone_table(spark, *shapes, borough="B"):
    rows = [(f"z{i}", borough, text) for i, text in enumerate(shapes)]
    return spark.createDataFrame(rows, "zone string, borough string, the_geom string")


def where(spark, index, *points):
    """The region names at each point."""
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    table = spark.createDataFrame(rows, "i int, x double, y double")
    found = regions_at(table, "x", "y", index).orderBy("i").collect()
    return [sorted(r.regions) for r in found]


def is_in(spark, shape, *points):
    edges = zones.zones_to_edges(zone_table(spark, shape))
    return [bool(r) for r in where(spark, build_index(edges), *points)]


@pytest.mark.parametrize(
    "shape, size",
    [(SQUARE, 1), (BACKWARD, 1), (TRIANGLE, 4), (ELL, 5), (HOLED, 12), (TWO_PARTS, 2), (EXPONENTS, 1)],
)
def test_area(spark, shape, size):
    edges = zones.zones_to_edges(zone_table(spark, shape))
    assert zones.area(edges, "borough").first().location_area == size
    assert zones.area(zones.dissolve(edges), "borough").first().location_area == size


def test_area_far_from_origin(spark):
    shape = "POLYGON ((-74.001 40.7, -74.0 40.7, -74.0 40.701, -74.001 40.701, -74.001 40.7))"
    edges = zones.zones_to_edges(zone_table(spark, shape))
    assert zones.area(edges, "zone").first().location_area == pytest.approx(1e-6, rel=1e-6)


def test_rings_run_with_their_inside_on_the_left(spark):
    for shape in (SQUARE, BACKWARD):
        edges = zones.zones_to_edges(zone_table(spark, shape)).collect()
        assert sum(e.x1 * e.y2 - e.x2 * e.y1 for e in edges) == 2
    hole = zones.zones_to_edges(zone_table(spark, HOLED)).where("ring_idx = 1").collect()
    assert sum(e.x1 * e.y2 - e.x2 * e.y1 for e in hole) == -8


def test_points_of_a_square(spark):
    points = [(0.5, 0.5), (1.5, 0.5), (-1, 0.5), (0.5, 2), (1, 0.5), (0.5, 0), (0, 0), (1, 1)]
    assert is_in(spark, SQUARE, *points) == [True] + [False] * 7
    assert is_in(spark, BACKWARD, *points) == [True] + [False] * 7


def test_points_of_other_shapes(spark):
    assert is_in(spark, TRIANGLE, (1, 1), (2, 1), (3, 1), (1, 0.5)) == [True, False, False, True]
    assert is_in(spark, ELL, (0.5, 2), (2, 2), (2, 0.5), (1, 2), (0.5, 1), (2, 1)) == [
        True, False, True, False, True, False,
    ]
    assert is_in(spark, HOLED, (0.5, 2), (2, 2), (1, 2), (0.5, 1), (0.5, 3), (3.5, 3)) == [
        True, False, False, True, True, True,
    ]
    assert is_in(spark, TWO_PARTS, (0.5, 0.5), (5.5, 5.5), (3, 3)) == [True, True, False]


def test_a_ray_through_vertices(spark):
    diamond = "POLYGON ((0 -1, 1 0, 0 1, -1 0, 0 -1))"
    assert is_in(spark, diamond, (0, 0), (-2, 0), (-2, 1), (-2, -1), (0.25, 0)) == [
        True, False, False, False, True,
    ]


def test_missing_and_far_coordinates_are_outside(spark):
    edges = zones.zones_to_edges(zone_table(spark, SQUARE))
    index = build_index(edges)
    rows = [(0, None, 0.5), (1, 0.5, None), (2, float("nan"), 0.5), (3, 0.5, float("nan")),
            (4, float("inf"), 0.5), (5, 1e300, -1e300), (6, 0.5, 0.5)]
    points = spark.createDataFrame(rows, "i int, x double, y double")
    for way in (index, index.shuffled()):
        assert [r.i for r in inside(points, "x", "y", way).collect()] == [6]
        assert sorted(r.i for r in outside(points, "x", "y", way).collect()) == [0, 1, 2, 3, 4, 5]


def test_texts_left_out(spark):
    bad = {
        "POLYGON Z ((0 0 1, 1 0 1, 1 1 1, 0 0 1))": "not two coordinates",
        "POLYGON ((0 0 1, 1 0 1, 1 1 1, 0 0 1))": "not two coordinates",
        "POLYGON ((0 0, 1 0, 1 1))": "ring not closed",
        "POLYGON ((0 0, 1 x, 1 1, 0 0))": "bad number",
        "POLYGON ((0 0, 1 NaN, 1 1, 0 0))": "bad number",
        "POLYGON ((0 0, 1 0, 1 1, 0 0)": "not a polygon",
        "POINT (1 1)": "not a polygon",
        "": "not a polygon",
        None: "not a polygon",
    }
    table = zone_table(spark, *bad, SQUARE, "MULTIPOLYGON EMPTY", "POLYGON EMPTY")
    found = {r.the_geom: r.fault for r in zones.rejected_zones(table).collect()}
    assert found == bad
    assert zones.zone_polygons(table).count() == 3
    assert zones.zones_to_edges(table).count() == 4


def test_no_zones_at_all(spark):
    index = build_index(zones.zones_to_edges(zone_table(spark, "POLYGON EMPTY")))
    assert where(spark, index, (0, 0)) == [[]]


SEAM = ("POLYGON ((0 0, 1 0, 1 2, 0 2, 0 0))", "POLYGON ((1 0, 2 0, 2 2, 1 2, 1 0))")
SHIFTED = ("POLYGON ((0 0, 1 0, 1 2, 0 2, 0 0))", "POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))")
CROSSED = ("POLYGON ((0 1, 3 1, 3 2, 0 2, 0 1))", "POLYGON ((1 0, 2 0, 2 3, 1 3, 1 0))")
NESTED = ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))")
INSCRIBED = ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((2 0, 4 2, 2 4, 0 2, 2 0))")
TWICE = (SQUARE, BACKWARD)
BITTEN = (SQUARE, "POLYGON ((-1 -1, 0.5 0, 0.75 -1, 1 0, 2 0, 1 0.5, 2 1, 5 5, -1 -1))")


def faults(spark, shapes):
    edges = zones.zones_to_edges(zone_table(spark, *shapes))
    grid, _ = fit_grid(edges, "borough")
    return {r.reason for r in overlaps(edges, grid).collect()}


def test_a_shared_border_dissolves(spark):
    edges = zones.zones_to_edges(zone_table(spark, *SEAM))
    assert zones.dissolve(edges).count() == 6
    assert zones.area(zones.dissolve(edges), "borough").first().location_area == 4
    index = build_index(edges)
    assert where(spark, index, (1, 1), (1, 0), (0.5, 1), (3, 1)) == [["B"], [], ["B"], []]


def test_overlaps_are_found(spark):
    assert faults(spark, SEAM) == set()
    assert faults(spark, SHIFTED) == set()
    assert "crossing edges" in faults(spark, CROSSED)
    assert faults(spark, NESTED) == {"overlapping corner"}
    assert faults(spark, INSCRIBED) == {"overlapping corner"}
    assert "repeated edge" in faults(spark, TWICE)
    assert "overlapping corner" in faults(spark, BITTEN)


def test_overlapping_zones_count_a_point_once(spark):
    for shapes, point in ((CROSSED, (1.5, 1.5)), (INSCRIBED, (2, 2)), (TWICE, (0.5, 0.5))):
        index = build_index(zones.zones_to_edges(zone_table(spark, *shapes)))
        assert where(spark, index, point, (9, 9)) == [["B"], []]




def test_overlaps_of_any_kind_keep_their_points(spark):
    """Borders that enter another zone through vertices, and lie on its borders."""
    index = build_index(zones.zones_to_edges(zone_table(spark, *BITTEN)))
    assert where(spark, index, (0.8, 0.3), (0.5, 0.5), (9, 9)) == [["B"], ["B"], []]


def test_a_seam_does_not_depend_on_other_regions(spark):
    apart = zone_table(spark, "POLYGON ((50 0, 54 0, 54 4, 50 4, 50 0))", "POLYGON ((51 1, 52 1, 52 2, 51 2, 51 1))", borough="C")
    index = build_index(zones.zones_to_edges(zone_table(spark, *SEAM).union(apart)))
    assert where(spark, index, (1, 1), (1, 0), (51, 1.5)) == [["B"], [], ["C"]]


def test_a_region_without_a_name(spark):
    shape = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    index = build_index(zones.zones_to_edges(zone_table(spark, shape, borough=None)))
    points = spark.createDataFrame([(5.0, 5.0), (0.05, 5.0), (11.0, 5.0)], "x double, y double")
    for way in (index, index.shuffled()):
        assert inside(points, "x", "y", way).count() == 2
        assert outside(points, "x", "y", way).count() == 1
        assert [r.borough for r in locate(points, "x", "y", way).collect()] == [None, None]


def test_area_is_not_told_where_zones_overlap(spark):
    table = zone_table(spark, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON ((1 0, 3 0, 3 2, 1 2, 1 0))")
    edges = zones.zones_to_edges(table.union(zone_table(spark, "POLYGON ((9 0, 10 0, 10 1, 9 1, 9 0))", borough="C")))
    found = zones.region_areas(edges, overlaps(edges, fit_grid(edges, "borough")[0])).collect()
    assert {r.borough: r.location_area for r in found} == {"B": None, "C": 1}
    assert {r.borough for r in found if r.reason} == {"B"}


def outline(spark, *shapes):
    edges = zones.dissolve(zones.zones_to_edges(zone_table(spark, *shapes)))
    return region_polygons(edges).first().polygons


def test_outlines_are_rings_in_order(spark):
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    assert outline(spark, BACKWARD) == [[square]]
    assert outline(spark, *SEAM) == [[[[0, 0], [1, 0], [2, 0], [2, 2], [1, 2], [0, 2], [0, 0]]]]
    assert outline(spark, TWO_PARTS) == [[square], [[[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]]]]
    assert outline(spark, HOLED) == [
        [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 3], [3, 3], [3, 1], [1, 1]]]
    ]


def test_outlines_that_touch_at_a_corner_stay_apart(spark):
    found = outline(spark, SQUARE, "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))")
    assert [len(p[0]) for p in found] == [5, 5]


def test_a_zone_listed_twice_is_one(spark):
    table = zone_table(spark, SQUARE).union(zone_table(spark, SQUARE))
    assert zones.zones_to_edges(table).count() == 4


def test_overlapping_regions_both_hold_the_point(spark):
    table = zone_table(spark, NESTED[0], borough="A").union(zone_table(spark, NESTED[1], borough="B"))
    index = build_index(zones.zones_to_edges(table))
    assert where(spark, index, (1.5, 1.5), (3, 3), (1, 1.5)) == [["A", "B"], ["A"], ["A"]]
    points = spark.createDataFrame([(1.5, 1.5), (3.0, 3.0)], "x double, y double")
    assert sorted(r.borough for r in locate(points, "x", "y", index).collect()) == ["A", "A", "B"]
    assert inside(points, "x", "y", index).count() == 2


def winding(ring, x, y):
    """How often a ring goes around a point off its edges, in rational arithmetic."""
    turns = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        if ay <= y < by and side > 0:
            turns += 1
        if by <= y < ay and side < 0:
            turns -= 1
    return turns


def exactly_inside(rings, x, y):
    """Is a ring around the point, or, if it lies on edges, around all near ones?"""
    rings = [[(Fraction(a), Fraction(b)) for a, b in ring] for ring in rings]
    x, y = Fraction(x), Fraction(y)
    near = [(x, y)]
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
            if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                tiny = Fraction(1, 10**6)
                near = [(x + tiny * u, y + tiny * v) for u in range(-29, 30, 2) for v in (-31, 31)]
                near += [(x + tiny * v, y + tiny * u) for u in range(-29, 30, 2) for v in (-31, 31)]
    return all(sum(winding(ring, a, b) for ring in rings) != 0 for a, b in near)


def counter_clockwise(ring):
    doubled = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:]))
    return ring[::-1] if doubled < 0 else ring


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    corners=st.lists(st.tuples(st.integers(-8, 8), st.integers(-8, 8)), min_size=3, max_size=9, unique=True),
    columns=st.sampled_from([1, 3, 16, 64]),
    bands=st.sampled_from([1, 2, 7, 64]),
)
def test_any_grid_gives_the_exact_answer(spark, corners, columns, bands):
    ring = [*corners, corners[0]]
    text = ", ".join(f"{x} {y}" for x, y in ring)
    edges = zones.zones_to_edges(zone_table(spark, f"POLYGON (({text}))"))
    points = [(x / 2, y / 2) for x in range(-18, 19) for y in range(-18, 19)]
    index = build_index(edges, columns=columns, bands=bands)
    found = [bool(r) for r in where(spark, index, *points)]
    assert found == [exactly_inside([counter_clockwise(ring)], x, y) for x, y in points]


def test_a_ragged_shape_with_many_edges(spark):
    random.seed(7)
    ring = [
        (round(r * math.cos(a), 6), round(r * math.sin(a), 6))
        for a, r in ((i * math.tau / 500, random.uniform(3, 5)) for i in range(500))
    ]
    ring.append(ring[0])
    text = ", ".join(f"{x!r} {y!r}" for x, y in ring)
    edges = zones.zones_to_edges(zone_table(spark, f"POLYGON (({text}))"))
    points = [(random.uniform(-5, 5), random.uniform(-5, 5)) for _ in range(800)]
    points += [ring[3], ring[100], (ring[5][0], 0.0), (0.0, ring[9][1])]
    wanted = [exactly_inside([ring], x, y) for x, y in points]
    index = build_index(edges)
    assert [bool(r) for r in where(spark, index, *points)] == wanted
    assert [bool(r) for r in where(spark, index.shuffled(), *points)] == wanted


def test_a_large_index_is_not_broadcast(spark):
    edges = zones.zones_to_edges(zone_table(spark, SQUARE))
    assert build_index(edges).small
    assert not build_index(edges, broadcast_limit=1000).small
