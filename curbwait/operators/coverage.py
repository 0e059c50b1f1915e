"""Do the zones of a region overlap? Then its area is not the sum of theirs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.functions.geometry import turn, windings
from curbwait.operators.grid import Grid, border_runs, edges_by_band, upward
from curbwait.operators.zones import dissolve, segments


def overlaps(zone_edges: DataFrame, grid: Grid, by: str = "borough") -> DataFrame:
    """Regions whose zones overlap, with the reasons found.

    Where two zones cover a place, that place has corners. Each is where two of their
    edges cross, or it is a corner of a zone, with the place on one side of it. Edges
    that run twice in the same direction are named apart.
    """
    repeated = repeated_edges(zone_edges, by)
    crossing = crossing_edges(zone_edges, grid, by)
    stacked = stacked_corners(zone_edges, grid, by)
    return repeated.union(crossing).union(stacked).distinct()


def repeated_edges(zone_edges: DataFrame, by: str) -> DataFrame:
    repeated = segments(zone_edges, by).where("abs(net) > 1")
    return repeated.selectExpr(f"region as {by}", "'repeated edge' as reason")


def crossing_edges(zone_edges: DataFrame, grid: Grid, by: str) -> DataFrame:
    """Edges of different zones that cross, looked for within each grid cell."""
    placed = edges_by_band(upward(zone_edges.withColumn("net", F.lit(1)), by, "zone"), grid).selectExpr(
        by,
        "zone",
        "band",
        "explode_outer(sequence(c0, c1)) as column",
        "struct(x1, y1, x2, y2) as e",
    )

    def apart(edge, other):
        ends = [turn(edge, f"{other}.x{i}", f"{other}.y{i}") for i in (1, 2)]
        return f"{ends[0]} * {ends[1]} < 0"

    same_cell = " and ".join(f"a.{c} <=> b.{c}" for c in (by, "band", "column"))
    crossing = f"{same_cell} and a.zone < b.zone and {apart('a.e', 'b.e')} and {apart('b.e', 'a.e')}"
    pairs = placed.alias("a").join(placed.alias("b"), F.expr(crossing), "left_semi")
    return pairs.selectExpr(by, "'crossing edges' as reason")


def stacked_corners(zone_edges: DataFrame, grid: Grid, by: str) -> DataFrame:
    """Zone corners with a side that two zones of the region cover."""
    borders = border_runs(dissolve(zone_edges, by).selectExpr("*", f"{by} as region"), grid)
    corners = zone_edges.selectExpr(f"{by} as home", "x1 as x", "y1 as y").distinct()
    corners = corners.selectExpr(
        "*", f"{grid.band('y')} as at", f"{grid.column('x')} as place"
    )
    stacked = corners.join(
        borders,
        F.expr(
            f"""home <=> region and at = band and place between run and run_end
                and exists({windings('edges', 'x', 'y', 'beyond')}, n -> abs(n) > 1)"""
        ),
        "left_semi",
    )
    return stacked.selectExpr(f"home as {by}", "'overlapping corner' as reason")
