"""Outlines with fewer vertices."""

import math
import random

import pytest
from test_geometry import zone_table

from curbwait.operators import zones
from curbwait.operators.rings import boundary_rings
from curbwait.operators.simplify import simplified


def wavy(rng, a, b, n):
    """Points from a to b, moved a little to either side."""
    (ax, ay), (bx, by) = a, b
    made = [a]
    for k in range(1, n):
        off = rng.uniform(-0.02, 0.02)
        made.append((round(ax + (bx - ax) * k / n - (by - ay) * off, 6), round(ay + (by - ay) * k / n + (bx - ax) * off, 6)))
    return made


def polygon(corners):
    return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*corners, corners[0]]) + "))"


def two_regions(spark, rng):
    """Squares that share a wavy side, one of them with a hole of eight corners."""
    sides = {}

    def side(a, b):
        if (b, a) in sides:
            return [a, *reversed(sides[b, a][1:])]
        sides[a, b] = wavy(rng, a, b, 12)
        return sides[a, b]

    left = side((0, 0), (1, 0)) + side((1, 0), (1, 1)) + side((1, 1), (0, 1)) + side((0, 1), (0, 0))
    right = side((1, 0), (2, 0)) + side((2, 0), (2, 1)) + side((2, 1), (1, 1)) + side((1, 1), (1, 0))
    hole = [(round(0.5 + 0.1 * math.cos(t * math.pi / 4), 6), round(0.5 - 0.1 * math.sin(t * math.pi / 4), 6)) for t in range(8)]
    text = polygon(left)[:-1] + ", " + polygon(hole)[len("POLYGON (") :]
    return zones.dissolve(
        zones.zones_to_edges(zone_table(spark, text, borough="L").union(zone_table(spark, polygon(right), borough="R")))
    )


def undirected(rows, region):
    return {frozenset([(r.x1, r.y1), (r.x2, r.y2)]) for r in rows if r.borough == region}


@pytest.mark.parametrize("area", [1e-4, 0.005, 10.0])
def test_regions_share_what_is_left(spark, area):
    edges = two_regions(spark, random.Random(3))
    before, after = edges.collect(), simplified(edges, area).collect()
    assert len(after) < len(before)
    assert undirected(before, "L") & undirected(before, "R")
    border = undirected(after, "L") & undirected(after, "R")
    ends = {v for e in border for v in e}
    assert {(1, 0), (1, 1)} <= ends
    # what both regions have of vertices between the two is the same
    inner = lambda region: {v for e in undirected(after, region) for v in e if 0.9 < v[0] < 1.1 and 0.1 < v[1] < 0.9}
    assert inner("L") == inner("R")
    kept = simplified(edges, area)
    rings = {r: boundary_rings(kept.where(f"borough = '{r}'")).count() for r in "LR"}
    assert rings == {"L": 2, "R": 1}
    if area < 0.01:
        for region in "LR":
            sizes = [zones.area(e.where(f"borough = '{region}'"), "borough").first().location_area for e in (edges, kept)]
            assert abs(sizes[0] - sizes[1]) < len(before) * area


def test_nothing_goes_at_no_area(spark):
    edges = two_regions(spark, random.Random(4))
    assert simplified(edges, 0.0).exceptAll(edges).isEmpty()
    assert simplified(edges.limit(0), 1.0).count() == 0


def test_a_triangle_stays(spark):
    edges = zones.dissolve(zones.zones_to_edges(zone_table(spark, "POLYGON ((0 0, 1 0, 1 1e-9, 0 0))")))
    assert simplified(edges, 1.0).count() == 3


def test_vertices_in_line_go(spark):
    square = "POLYGON ((0 0, 0.25 0, 0.5 0, 1 0, 1 1, 0.5 1, 0 1, 0 0.5, 0 0))"
    edges = zones.dissolve(zones.zones_to_edges(zone_table(spark, square)))
    assert simplified(edges, 0.0).count() == 4
