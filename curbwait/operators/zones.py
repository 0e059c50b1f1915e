"""Zone polygons as edge tables: parsing, area, dissolving."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.functions.geometry import (
    oriented,
    point,
    polygon_fault,
    polygons_from_wkt,
    ring_ends,
    ring_starts,
)


def parse_zones(zones: DataFrame) -> DataFrame:
    """Zones with their polygons as nested arrays, and ``fault``, null if usable.

    The generator has the text parsed once: filters are not pushed below it.
    """
    return zones.selectExpr(
        "*", f"explode_outer(array({polygons_from_wkt('the_geom')})) as polygons"
    ).selectExpr("*", f"{polygon_fault('the_geom', 'polygons')} as fault")


def rejected_zones(zones: DataFrame) -> DataFrame:
    """Zones left out of every other job here, with the reason."""
    return parse_zones(zones).where("fault is not null").drop("polygons")


def zone_polygons(zones: DataFrame) -> DataFrame:
    """One row per usable zone, repeats of a zone dropped."""
    return (
        parse_zones(zones.select("zone", "borough", "the_geom").distinct())
        .where("fault is null")
        .select("zone", "borough", "polygons")
    )


def zones_to_edges(zones: DataFrame) -> DataFrame:
    """One row per polygon segment, with the zone's inside on its left."""
    pair = "(a, b) -> struct(a as a, b as b)"
    steps = f"zip_with({ring_starts('ring')}, {ring_ends('ring')}, {pair})"
    return (
        zone_polygons(zones)
        .selectExpr("zone", "borough", "posexplode_outer(polygons) as (poly_idx, polygon)")
        .selectExpr("zone", "borough", "poly_idx", "posexplode_outer(polygon) as (ring_idx, raw)")
        .where("raw is not null")
        .selectExpr("*", f"{oriented('raw', 'ring_idx = 0')} as ring")
        .selectExpr("zone", "borough", "poly_idx", "ring_idx", f"inline_outer({steps})")
        .where("a <> b")
        .selectExpr(
            "zone",
            "borough",
            "poly_idx",
            "ring_idx",
            "a[0] as x1",
            "a[1] as y1",
            "b[0] as x2",
            "b[1] as y2",
        )
    )


def area(edges: DataFrame, by: str) -> DataFrame:
    """Planar area per ``by``, largest first; where zones overlap it counts twice."""
    times = "net" if "net" in edges.columns else "1"
    return (
        edges.groupBy(by)
        .agg(F.expr(f"abs(sum({times} * (x1 + x2) * (y2 - y1) / 2)) as location_area"))
        .orderBy(F.desc("location_area"), by)
    )


def segments(edges: DataFrame, by: str) -> DataFrame:
    """Coinciding edges of a region as one row: ``n`` of them, ``net`` of which
    run from the lesser end (x, y) to the greater end (qx, qy). ``zone`` is whose
    the edge is, or one of those."""
    start, stop = point("x1", "y1"), point("x2", "y2")
    return (
        edges.selectExpr(
            f"{by} as _by",
            "zone",
            f"least({start}, {stop}) as p",
            f"greatest({start}, {stop}) as q",
            f"if({start} <= {stop}, 1, -1) as way",
        )
        .groupBy("_by", "p.x", "p.y", F.expr("q.x as qx"), F.expr("q.y as qy"))
        .agg(F.expr("min(zone) as zone"), F.expr("count(*) as n"), F.expr("sum(way) as net"))
        .withColumnRenamed("_by", "region")
    )


def dissolve(edges: DataFrame, by: str = "borough") -> DataFrame:
    """Outer boundary per ``by``: borders between its own zones drop out. ``net`` is how
    many zones more are on an edge's left than on its right.

    This is the polygons' union where zones do not overlap and neighbours share
    their border vertex for vertex. Winding numbers over it are right in any case.
    """
    return (
        segments(edges, by)
        .where("net <> 0")
        .selectExpr(
            f"region as {by}",
            "if(net > 0, x, qx) as x1",
            "if(net > 0, y, qy) as y1",
            "if(net > 0, qx, x) as x2",
            "if(net > 0, qy, y) as y2",
            "abs(net) as net",
        )
    )


def region_areas(edges: DataFrame, overlapping: DataFrame, by: str = "borough") -> DataFrame:
    """Area per region; null, with the ``reason``, for regions whose zones overlap:
    ``overlapping`` has those and reasons."""
    reasons = overlapping.withColumnRenamed(by, "region").groupBy("region").agg(F.expr("concat_ws(', ', array_sort(collect_set(reason))) as reason"))
    sizes = area(dissolve(edges, by), by)
    joined = sizes.join(reasons, sizes[by].eqNullSafe(reasons["region"]), "left")
    return joined.select(
        by, F.expr("if(reason is null, location_area, null) as location_area"), "reason"
    ).orderBy(F.desc("location_area"), by)
