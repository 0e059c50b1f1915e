"""Which regions a point lies in: an exact spatial join on equi-keys.

Cells are laid over the regions' borders: bands, and columns of each band. A point finds
its band by a search in the bands' limits, its column by one in the limits that a first
lookup brings, and a second lookup brings its cell. There the few edges of the cell say
how often each region's border goes around the point, starting from a place in the cell
for which that is known. Edges and points find bands and columns by the same search, so
the shortcut never changes an answer.

A region may be without a name; inside the index regions are structs, never null.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.functions.geometry import contains
from curbwait.operators.cells import Cells, cell_key, fit_cells, from_known
from curbwait.operators.grid import upward
from curbwait.operators.zones import dissolve
from curbwait.session import written

SALTS = 16
APART = 1 << 20


@dataclass(frozen=True)
class RegionIndex:
    """``small``: both of the tables are proven to fit a broadcast."""

    by: str
    held: Cells
    small: bool

    def shuffled(self) -> "RegionIndex":
        """The same index, joined by shuffle instead of broadcast."""
        return replace(self, small=False)


def build_index(
    zone_edges: DataFrame,
    by: str = "borough",
    columns: int | None = None,
    bands: int | None = None,
    broadcast_limit: int = 256 << 20,
) -> RegionIndex:
    """Index regions for lookup. A region is wherever any of its zones is; zones may
    overlap, share borders, or come in pieces.

    The index is written below the shared folder, as several jobs read it: those jobs
    then plan on bare tables, and a job that looks up twice broadcasts once. Its rows
    grow with the edges as n log n at most, whatever their shape; its size is measured.
    """
    edges = upward(dissolve(zone_edges, by).selectExpr("*", f"{by} as region"), "region")
    held = fit_cells(written(edges, "borders")[0], bands, columns)
    return RegionIndex(by, held, held.bytes <= broadcast_limit)


def regions_at(
    points: DataFrame, x: str, y: str, index: RegionIndex, found: str = "regions"
) -> DataFrame:
    """The points with an array of the regions each lies in, empty if none or if
    a coordinate is missing."""
    held = _structs_at(points, x, y, index, "_found")
    return held.selectExpr(
        *[f"`{c}`" for c in points.columns], f"transform(_found, r -> r.region) as {found}"
    )


def _structs_at(points: DataFrame, x: str, y: str, index: RegionIndex, found: str) -> DataFrame:
    held = index.held
    keyed = points.selectExpr("*", f"if({held.bands.covers(x, y)}, {held.bands.band(y)}, null) as _band")
    in_band = _lookup(keyed, index, held.layout, "_band")
    column = f"if(_limits is null, null, {cell_key('_band', held.column(x))})"
    in_cell = _lookup(in_band.selectExpr("*", f"{column} as _cell"), index, held.cells, "_cell")
    inside = contains("p.edges", x, y, from_known("p", y))
    hits = f"transform(filter(coalesce(_parts, array()), p -> {inside}), p -> p.of)"
    return in_cell.selectExpr(*[f"`{c}`" for c in points.columns], f"{hits} as {found}")


def _lookup(points: DataFrame, index: RegionIndex, table: DataFrame, key: str) -> DataFrame:
    """Left join with one of the index's tables on its key.

    If that cannot be broadcast, every row of it is there once for each salt, and points
    pick theirs by all their columns and the partition they are in, so those of a busy
    place, equal ones too, spread over tasks. Points without a key, which find nothing,
    get one of their own for the join.
    """
    if index.small:
        return points.join(F.broadcast(table), key, "left")
    own = f"xxhash64({', '.join(f'`{c}`' for c in points.columns if c != '_limits')}, spark_partition_id())"
    salted = points.withColumn("_own", F.expr(own)).withColumns(
        {
            "_salt": F.expr(f"cast(pmod(_own, {SALTS}) as int)"),
            key: F.expr(f"coalesce({key}, cast(-1 - pmod(_own, {APART}) as {'int' if key == '_band' else 'bigint'}))"),
        }
    )
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt", "_own")


def locate(points: DataFrame, x: str, y: str, index: RegionIndex, name: str | None = None) -> DataFrame:
    """Inner join of points with the regions that contain them; the name may be null."""
    name = name or index.by
    found = _structs_at(points, x, y, index, "_found")
    # an outer generator: a plain one would have the lookup computed twice, once
    # to filter out the empty arrays
    return (
        found.select(*points.columns, F.explode_outer("_found").alias("_region"))
        .where("_region is not null")
        .select(*points.columns, F.col("_region.region").alias(name))
    )


def inside(points: DataFrame, x: str, y: str, index: RegionIndex) -> DataFrame:
    """Points in some region, each once."""
    return flagged(points, x, y, index, "_inside").where("_inside").drop("_inside")


def outside(points: DataFrame, x: str, y: str, index: RegionIndex) -> DataFrame:
    """Points in no region, those with a missing coordinate among them."""
    return flagged(points, x, y, index, "_inside").where("not _inside").drop("_inside")


def flagged(
    points: DataFrame, x: str, y: str, index: RegionIndex, name: str = "in_service_area"
) -> DataFrame:
    """The points with a flag: are they in some region?"""
    found = _structs_at(points, x, y, index, "_found")
    return found.withColumn(name, F.expr("size(_found) > 0")).drop("_found")
