"""The union of a region's zones, whatever way they touch or overlap, by noding.

Borders are cut wherever a vertex of the region lies on them or two of them cross, so
that the pieces meet at their ends only. A piece has the same winding number all along
either side; those with zero on exactly one side are the outline of the union.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbwait.functions.geometry import point, turn
from curbwait.operators.grid import Grid, border_runs, edges_by_band, fit_grid, upward
from curbwait.operators.zones import area, dissolve

#: Bits of the largest coordinate beyond which places are not told apart.
DIGITS = 44


def union_edges(zone_edges: DataFrame, by: str = "borough", grid: Grid | None = None) -> DataFrame:
    """Edges of the union's outline per ``by``, with the inside on the left; ``net`` is 1,
    for whoever takes dissolved edges.

    Neighbours need not share their vertices, and zones may overlap in any way. A vertex
    closer to a border than 2 ** -44 of the largest coordinate lies on it, and crossings
    are rounded to that; so corners move by no more. Edges are compared within the cells
    of a grid, and sides are taken from the border's runs along its bands.
    """
    grid = grid or fit_grid(zone_edges, by)[0]
    pieces = noded(dissolve(zone_edges, by), grid, by)
    sides = _sides(pieces, grid)
    kept = sides.where("(east = 0) <> (west = 0)")
    ahead = "if(y1 = y2, east <> 0, west <> 0)"
    return kept.selectExpr(
        f"region as {by}",
        f"if({ahead}, x1, x2) as x1",
        f"if({ahead}, y1, y2) as y1",
        f"if({ahead}, x2, x1) as x2",
        f"if({ahead}, y2, y1) as y2",
        "1L as net",
    )


def union_areas(zone_edges: DataFrame, by: str = "borough") -> DataFrame:
    """Area per ``by``, what several of its zones cover counted once."""
    return area(union_edges(zone_edges, by), by)


def _unit(grid: Grid) -> float:
    most = max(abs(v) for v in (grid.x0, grid.y0, grid.x1, grid.y1)) or 1.0
    return 2.0 ** (math.frexp(most)[1] - DIGITS)


def noded(edges: DataFrame, grid: Grid, by: str = "borough") -> DataFrame:
    """Dissolved edges cut at each other: ``region`` and pieces that meet at ends only,
    coinciding ones as one, those that cancel out left out."""
    lines = upward(edges.selectExpr("*", f"{by} as region"), "region")
    whole = lines.selectExpr("region", "struct(x1, y1, x2, y2) as e", "w")
    spots = (
        _cuts(lines, grid)
        .unionByName(whole.selectExpr("region", "e", f"{point('e.x1', 'e.y1')} as p"))
        .unionByName(whole.selectExpr("region", "e", f"{point('e.x2', 'e.y2')} as p"))
        .distinct()
    )
    along = "(p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1)"
    onward = F.lead("p").over(Window.partitionBy("region", "e").orderBy("at", "p"))
    steps = spots.selectExpr("region", "e", "p", f"{along} as at").withColumn("q", onward).where("q is not null")
    cut = steps.alias("s").join(
        whole.alias("l"), F.expr("s.region <=> l.region and s.e = l.e")
    )
    pieces = cut.selectExpr(
        "s.region as region", "'' as zone", "s.p.x as x1", "s.p.y as y1", "s.q.x as x2", "s.q.y as y2", "l.w as w"
    )
    merged = (
        pieces.selectExpr(
            "region",
            f"least({point('x1', 'y1')}, {point('x2', 'y2')}) as p",
            f"greatest({point('x1', 'y1')}, {point('x2', 'y2')}) as q",
            f"if({point('x1', 'y1')} <= {point('x2', 'y2')}, w, -w) as w",
        )
        .where("p <> q")
        .groupBy("region", "p", "q")
        .agg(F.sum("w").alias("net"))
        .where("net <> 0")
    )
    return merged.selectExpr("region", "p.x as x1", "p.y as y1", "q.x as x2", "q.y as y2", "net")


def _cuts(lines: DataFrame, grid: Grid) -> DataFrame:
    """``region``, edge ``e`` and the places ``p`` at which others of the region cut it,
    found cell by cell."""
    unit = _unit(grid)
    placed = edges_by_band(lines, grid).selectExpr(
        "region", "band", "explode_outer(sequence(c0, c1)) as column", "struct(x1, y1, x2, y2) as e"
    )
    same = "a.region <=> b.region and a.band = b.band and a.column = b.column and a.e < b.e"
    pairs = placed.alias("a").join(placed.alias("b"), F.expr(same)).selectExpr(
        "a.region as region", "a.e as a", "b.e as b"
    )

    def near(e: str, x: str, y: str) -> str:
        """Is the place on the edge's line, as near as places are told apart?"""
        return f"abs({turn(e, x, y)}) <= {unit!r}D * (abs({e}.x2 - {e}.x1) + abs({e}.y2 - {e}.y1))"

    def within(e: str, x: str, y: str) -> str:
        run = f"(({x} - {e}.x1) * ({e}.x2 - {e}.x1) + ({y} - {e}.y1) * ({e}.y2 - {e}.y1))"
        size = f"(({e}.x2 - {e}.x1) * ({e}.x2 - {e}.x1) + ({e}.y2 - {e}.y1) * ({e}.y2 - {e}.y1))"
        return f"({run} > 0 and {run} < {size})"

    def at_vertex(e: str, other: str, k: int) -> str:
        x, y = f"{other}.x{k}", f"{other}.y{k}"
        return f"if({near(e, x, y)} and {within(e, x, y)}, struct({e} as e, {point(x, y)} as p), null)"

    def apart(e: str, other: str) -> str:
        ends = [(f"{other}.x{k}", f"{other}.y{k}") for k in (1, 2)]
        sides = " * ".join(f"signum({turn(e, x, y)})" for x, y in ends)
        return " and ".join([f"{sides} < 0", *(f"not {near(e, x, y)}" for x, y in ends)])

    cross = "((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1))"
    share = f"(((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / {cross})"
    snapped = lambda v: f"(rint(({v}) / {unit!r}D) * {unit!r}D)"
    meet = point(snapped(f"a.x1 + {share} * (a.x2 - a.x1)"), snapped(f"a.y1 + {share} * (a.y2 - a.y1)"))
    crossing = f"{apart('a', 'b')} and {apart('b', 'a')}"
    found = [at_vertex(e, other, k) for e, other in (("a", "b"), ("b", "a")) for k in (1, 2)]
    found += [f"if({crossing}, struct({e} as e, {meet} as p), null)" for e in ("a", "b")]
    return (
        pairs.selectExpr("region", f"explode_outer(array({', '.join(found)})) as cut")
        .where("cut is not null")
        .selectExpr("region", "cut.e as e", "cut.p as p")
    )


def _sides(pieces: DataFrame, grid: Grid) -> DataFrame:
    """Pieces, lower end first, with their winding numbers ``east`` and ``west``: to the
    right of each and to the left, or above and below those that run level.

    A piece has its middle in a run of its own border, so the run's edges and the number
    beyond its end say how many pieces lie to the right of the middle.
    """
    x, y = "((s.x1 + s.x2) / 2)", "((s.y1 + s.y2) / 2)"
    others = f"e <> s and e.y1 <= {y} and {y} < e.y2 and {turn('e', x, y)} > 0"
    east = f"aggregate(filter(edges, e -> {others}), cast(beyond as bigint), (n, e) -> n + e.w)"
    here = f"filter(edges, s -> {grid.band(y)} = band)"
    found = f"transform({here}, s -> struct(s as s, {east} as east))"
    return (
        border_runs(pieces, grid)
        .selectExpr("region", f"inline({found})")
        .selectExpr("region", "s.x1", "s.y1", "s.x2", "s.y2", "east", "if(s.y1 = s.y2, east - s.w, east + s.w) as west")
    )
