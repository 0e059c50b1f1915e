"""Unions of zones that touch, cross and cover each other, against exact arithmetic."""

import random
from fractions import Fraction

import pytest
from test_geometry import BITTEN, CROSSED, HOLED, INSCRIBED, NESTED, SEAM, TWICE, TWO_PARTS, where, zone_table

from curbwait.operators import zones
from curbwait.operators.grid import Grid
from curbwait.operators.locate import build_index
from curbwait.operators.rings import region_polygons
from curbwait.operators.union import noded, union_areas, union_edges


def box(left, low, right, high):
    return f"POLYGON (({left} {low}, {right} {low}, {right} {high}, {left} {high}, {left} {low}))"


def edges_of(spark, *shapes, borough="B"):
    return zones.zones_to_edges(zone_table(spark, *shapes, borough=borough))


def outline(spark, *shapes):
    return region_polygons(union_edges(edges_of(spark, *shapes))).first().polygons


def size(spark, *shapes):
    return union_areas(edges_of(spark, *shapes)).first().location_area


def test_a_t_junction_is_one_outline(spark):
    found = outline(spark, box(0, 0, 1, 2), box(1, 0, 2, 1), box(1, 1, 2, 2))
    assert found == [[[[0, 0], [1, 0], [2, 0], [2, 1], [2, 2], [1, 2], [0, 2], [0, 0]]]]


def test_a_vertex_beside_a_slanted_border_by_rounding(spark):
    third = 1 / 3
    parts = (f"POLYGON ((0 0, {third!r} 0.1, 0 1, 0 0))", f"POLYGON (({third!r} 0.1, 1 0.3, 0 1, {third!r} 0.1))")
    found = outline(spark, "POLYGON ((0 0, 1 0.3, 1 -1, 0 0))", *parts)
    assert len(found) == 1 and len(found[0]) == 1
    assert [1 / 3, 0.1] not in found[0][0]


@pytest.mark.parametrize(
    "shapes, wanted",
    [
        ((box(0, 0, 2, 2), box(1, 0, 3, 2)), 6),
        (SEAM, 4),
        (CROSSED, 5),
        (NESTED, 16),
        (INSCRIBED, 16),
        (TWICE, 1),
        ((HOLED, box(1, 1, 3, 3)), 16),
        ((HOLED, box(2, 2, 5, 3)), 14),
        ((TWO_PARTS,), 2),
        ((box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 0.5, 1, 2.5), box(2, 0.5, 3, 2.5)), 8),
    ],
)
def test_areas(spark, shapes, wanted):
    assert size(spark, *shapes) == wanted


def test_overlaps_leave_holes_and_parts(spark):
    found = outline(spark, box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 0.5, 1, 2.5), box(2, 0.5, 3, 2.5), box(9, 9, 10, 10))
    assert [len(p) for p in found] == [2, 1]
    assert sorted(found[0][1]) == [[1, 1], [1, 1], [1, 2], [2, 1], [2, 2]]


def test_pieces_meet_at_their_ends_only(spark):
    edges = edges_of(spark, *BITTEN)
    pieces = noded(zones.dissolve(edges), Grid(-1.0, -1.0, 5.0, 5.0, 7, 5)).collect()
    corner = {(p.x1, p.y1) for p in pieces} | {(p.x2, p.y2) for p in pieces}
    for p in pieces:
        for x, y in corner - {(p.x1, p.y1), (p.x2, p.y2)}:
            side = (p.x2 - p.x1) * (y - p.y1) - (x - p.x1) * (p.y2 - p.y1)
            along = (p.x2 - p.x1) * (x - p.x1) + (p.y2 - p.y1) * (y - p.y1)
            assert abs(side) > 1e-9 or not 0 < along < (p.x2 - p.x1) ** 2 + (p.y2 - p.y1) ** 2


def exact_area(shapes):
    """Of a union of triangles: slabs between all corners and crossings."""
    sides = [[(t[k], t[(k + 1) % 3]) for k in range(3)] for t in shapes]
    flat = [s for t in sides for s in t]
    heights = {Fraction(p[1]) for t in shapes for p in t}
    for i, ((ax, ay), (bx, by)) in enumerate(flat):
        for (cx, cy), (dx, dy) in flat[:i]:
            cross = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if cross:
                t = Fraction((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), cross)
                u = Fraction((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), cross)
                if 0 <= t <= 1 and 0 <= u <= 1:
                    heights.add(ay + t * (by - ay))
    heights, total = sorted(heights), Fraction(0)
    for low, high in zip(heights, heights[1:]):
        mid, spans = (low + high) / 2, []
        for triangle in sides:
            xs = [ax + (mid - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in triangle if min(ay, by) < mid < max(ay, by)]
            if xs:
                spans.append((min(xs), max(xs)))
        far = None
        for a, b in sorted(spans):
            start = a if far is None else max(a, far)
            total += max(0, b - start) * (high - low)
            far = b if far is None else max(far, b)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_unions_of_triangles(spark, seed):
    rng = random.Random(seed)
    triangles = []
    while len(triangles) < 12:
        corners = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(3)]
        (ax, ay), (bx, by), (cx, cy) = corners
        if (bx - ax) * (cy - ay) != (by - ay) * (cx - ax):
            triangles.append(corners)
    texts = ["POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*t, t[0]]) + "))" for t in triangles]
    edges = edges_of(spark, *texts)
    united = union_edges(edges)
    assert zones.area(united, "borough").first().location_area == pytest.approx(float(exact_area(triangles)), rel=1e-9)
    points = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(200)]
    named = united.selectExpr("'u' as zone", "*")
    assert where(spark, build_index(named), *points) == where(spark, build_index(edges), *points)
    assert region_polygons(united).count() == 1


def test_regions_are_united_apart(spark):
    edges = edges_of(spark, box(0, 0, 2, 2), box(1, 0, 3, 2)).union(edges_of(spark, box(0, 0, 3, 2), borough=None))
    found = {r.borough: r.location_area for r in union_areas(edges).collect()}
    assert found == {"B": 6, None: 6}


def test_no_zones(spark):
    assert union_edges(edges_of(spark, "POLYGON EMPTY")).collect() == []
