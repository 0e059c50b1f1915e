"""Boundary edges chained into rings, and rings into polygons, by joins."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbwait.functions.geometry import contains, point, ring_area, ring_ends, ring_starts
from curbwait.session import drop_scratch, written


def boundary_rings(edges: DataFrame, by: str = "borough") -> DataFrame:
    """One row per ring of dissolved edges: its region, and ``ring``, its vertices from
    the least (x, y) on, the first repeated last, with the inside on the left.

    Every edge points to the next one. Pointers are doubled each round, with the least
    edge met so far and the steps to it, until none learns of a lesser one; then the
    steps order the ring. Only a ring's own vertices meet in a row.
    """
    spark = edges.sparkSession
    held, path = written(_followed(edges, by), "ring_steps")
    span = 1
    while True:
        ahead = held.select(
            F.col("region").alias("_region"),
            F.col("id").alias("_id"),
            F.col("next").alias("_next"),
            F.col("low").alias("_low"),
        )
        joined = held.join(
            ahead, held["region"].eqNullSafe(ahead["_region"]) & (held["next"] == ahead["_id"]), "left"
        )
        further = f"named_struct('id', _low.id, 'steps', _low.steps + {span})"
        stepped, next_path = written(
            joined.selectExpr(
                "region", "id", "_next as next", f"least(low, {further}) as low", "_low.id < low.id as learned"
            ),
            "ring_steps",
        )
        learned = not stepped.where("learned").isEmpty()
        drop_scratch(spark, path)
        held, path, span = stepped.drop("learned"), next_path, 2 * span
        if not learned:
            break
    # the least edge is first, then the one with most steps back to it
    in_order = "array_sort(collect_list(struct(if(low.steps = 0, 0, 1) as a, -low.steps as b, array(id.x, id.y) as v)))"
    vertices = f"transform({in_order}, r -> r.v)"
    return (
        held.groupBy("region", F.expr("low.id as first"))
        .agg(F.expr(f"{vertices} as open"))
        .selectExpr(f"region as {by}", "concat(open, array(open[0])) as ring")
    )


def _followed(edges: DataFrame, by: str) -> DataFrame:
    """Edges with the next one: of those that start where it ends, the sharpest turn to
    the left, so that rings that touch at a vertex stay apart. ``low``: itself."""
    rows = edges.selectExpr(
        f"{by} as region",
        "named_struct('x', x1, 'y', y1, 'qx', x2, 'qy', y2) as id",
        f"{point('x1', 'y1')} as start",
        f"{point('x2', 'y2')} as stop",
    )
    ahead = rows.selectExpr("region as _region", "start as _start", "id as _id")
    same = rows["region"].eqNullSafe(ahead["_region"]) & (rows["stop"] == ahead["_start"])
    turn = "atan2(_id.qy - _id.y, _id.qx - _id.x) - atan2(id.qy - id.y, id.qx - id.x)"
    left = f"round(pmod({turn} + pi(), 2 * pi()), 12)"
    return (
        rows.join(ahead, same)
        .groupBy("region", "id")
        .agg(F.expr(f"max_by(_id, {left}) as next"))
        .selectExpr("region", "id", "next", "named_struct('id', id, 'steps', 0) as low")
    )


def region_polygons(edges: DataFrame, by: str = "borough") -> DataFrame:
    """``polygons`` of each region: its shells, by their first vertices, each followed by
    the holes in it."""
    rings = boundary_rings(edges, by).selectExpr(f"{by} as region", "ring", f"{ring_area('ring')} as size")
    steps = f"zip_with({ring_starts('ring')}, {ring_ends('ring')}, (a, b) -> struct(a, b))"
    upward = f"""transform({steps}, s -> if(s.a[1] < s.b[1] or (s.a[1] = s.b[1] and s.a[0] < s.b[0]),
        named_struct('x1', s.a[0], 'y1', s.a[1], 'x2', s.b[0], 'y2', s.b[1], 'w', 1),
        named_struct('x1', s.b[0], 'y1', s.b[1], 'x2', s.a[0], 'y2', s.a[1], 'w', -1)))"""
    shells = rings.where("size > 0").selectExpr("region", "ring as shell", "size as room", f"{upward} as edges")
    holes = rings.where("size < 0").selectExpr(
        "region as _region",
        "ring as hole",
        "(ring[0][0] + ring[1][0]) / 2 as x",
        "(ring[0][1] + ring[1][1]) / 2 as y",
    )
    around = F.expr(f"region <=> _region and {contains('edges', 'x', 'y')}")
    least = F.row_number().over(Window.partitionBy("region", "hole").orderBy("room", "shell"))
    within = (
        holes.join(shells, around)
        .withColumn("nth", least)
        .where("nth = 1")
        .groupBy(F.col("region").alias("_region"), F.col("shell").alias("_shell"))
        .agg(F.expr("array_sort(collect_list(hole)) as holes"))
    )
    held = shells.join(
        within, F.expr("region <=> _region and shell = _shell"), "left"
    ).selectExpr("region", "concat(array(shell), coalesce(holes, array())) as polygon")
    return held.groupBy("region").agg(F.expr("array_sort(collect_list(polygon)) as polygons")).withColumnRenamed(
        "region", by
    )
