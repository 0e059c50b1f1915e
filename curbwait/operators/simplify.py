"""Outlines with fewer vertices, the same for both regions of a border.

Vertices that part the least area go first, as rounds of joins: those of two neighbours
that have less than both of these. Where borders of several regions meet, nothing goes.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.functions.geometry import point
from curbwait.operators.rings import boundary_rings
from curbwait.session import drop_scratch, written


def simplified(edges: DataFrame, area: float, by: str = "borough") -> DataFrame:
    """Outline edges (as of ``dissolve`` or ``union_edges``, inside on the left) with the
    vertices left out that part no more than ``area`` from their neighbours.

    Regions that share a border vertex for vertex share it afterwards, as a vertex goes
    from all of its regions or from none. Every ring keeps three vertices that are not in
    line: the least and the greatest, and the one farthest from the line between these.
    Each round is a few joins on vertices and is written; rounds end when nothing goes.
    Lines may come to cross others that were nearer than what goes.
    """
    spark = edges.sparkSession
    fixed, fixed_path = written(_fixed(edges, by), "fixed")
    held, path = written(
        edges.selectExpr(f"{by} as region", f"{point('x1', 'y1')} as a", f"{point('x2', 'y2')} as b"), "outlines"
    )
    while True:
        gone, gone_path = written(_going(held, fixed, area), "gone")
        done = gone.isEmpty()
        if not done:
            held, next_path = written(_without(held, gone), "outlines")
            drop_scratch(spark, path)
            path = next_path
        drop_scratch(spark, gone_path)
        if done:
            break
    drop_scratch(spark, fixed_path)
    return held.selectExpr(f"region as {by}", "a.x as x1", "a.y as y1", "b.x as x2", "b.y as y2", "1L as net")


def _cross(o: str, p: str, q: str) -> str:
    return f"(({p}.x - {o}.x) * ({q}.y - {o}.y) - ({q}.x - {o}.x) * ({p}.y - {o}.y))"


def _fixed(edges: DataFrame, by: str) -> DataFrame:
    """Vertices that stay: three of every ring."""
    corners = "transform(ring, v -> named_struct('x', v[0], 'y', v[1]))"
    ends = boundary_rings(edges, by).selectExpr(f"{corners} as vs").selectExpr("vs", "array_min(vs) as low", "array_max(vs) as high")
    far = f"array_max(transform(vs, v -> struct(abs({_cross('low', 'high', 'v')}) as d, v as v))).v"
    return ends.selectExpr(f"explode(array(low, high, {far})) as v").distinct()


def _going(held: DataFrame, fixed: DataFrame, area: float) -> DataFrame:
    """Vertices ``v`` that go in this round, no two of them neighbours."""
    steps = held.selectExpr("region", "a as v", "b as other").union(held.selectExpr("region", "b", "a"))
    around = steps.groupBy("v").agg(
        F.collect_set("other").alias("near"), F.count("*").alias("n"), F.count_distinct(F.struct("region")).alias("regions")
    )
    able = around.where("size(near) = 2 and n = 2 * regions").join(fixed, "v", "left_anti")
    sized = able.selectExpr("v", "near[0] as p", "near[1] as q", f"abs({_cross('v', 'near[0]', 'near[1]')}) / 2 as parted")
    sized = sized.where(f"parted <= {area!r}D")
    # where the two neighbours are joined already, the three are a ring
    joined = held.selectExpr("least(a, b) as p", "greatest(a, b) as q").distinct()
    sized = sized.selectExpr("v", "least(p, q) as p", "greatest(p, q) as q", "parted").join(joined, ["p", "q"], "left_anti")
    ranked = sized.selectExpr("v", "p", "q", "struct(parted, v) as rank")
    other = ranked.selectExpr("v as neighbour", "rank as theirs")
    met = ranked.selectExpr("v", "rank", "explode(array(p, q)) as neighbour").join(other, "neighbour", "left")
    return met.groupBy("v").agg(F.expr("bool_and(theirs is null or rank < theirs)").alias("goes")).where("goes").select("v")


def _without(held: DataFrame, gone: DataFrame) -> DataFrame:
    """The outlines without the vertices, their neighbours joined."""
    into = held.join(gone, held["b"] == gone["v"], "left_semi").selectExpr("region", "a as start", "b as v")
    onward = held.join(gone, held["a"] == gone["v"], "left_semi").selectExpr("region as _region", "a as _v", "b as stop")
    joined = into.join(onward, F.expr("region <=> _region and v = _v")).selectExpr("region", "start as a", "stop as b")
    kept = held.join(gone, held["a"] == gone["v"], "left_anti").join(gone, held["b"] == gone["v"], "left_anti")
    return kept.unionByName(joined)
