"""Cells over region borders: bands of equal depth, each cut into columns of equal depth.

Limits of bands are heights at which edges end, those of a band's columns are places
where its edges begin, all picked by quantiles; so dense parts get many cells, and bare
ones few. A cell has the edges that pass through it and, for one place in it, the number
of times each region's border goes around; any other place of the cell is decided from
these alone, by the edges on the way to that one.
"""

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbwait.functions.geometry import side
from curbwait.session import written

#: Edges that end in a band, and that a cell begins with, about.
ENDS, BEGUN = 16, 4
MOST_BANDS, MOST_COLUMNS = 1 << 12, 1 << 12
#: Lines at equal distances, level and upright, that are limits besides.
LINES = 64
#: Where in its cell the known place lies, off any regular grid.
INNER = (math.sqrt(5) - 1) / 2
_SHIFT = 20
EDGE = "named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2, 'w', w)"
EDGE_BYTES, ROW_BYTES = 64, 512


def step_of(value: str, limits: str, most: int) -> str:
    """The last of ``most`` ascending limits, or fewer, that the value reaches; 0 if none. A
    binary search."""
    steps = ", ".join(str(1 << k) for k in reversed(range(max(1, most - 1).bit_length())))
    return f"""aggregate(array({steps}), 0, (p, s) ->
        if(p + s < size({limits}) and {value} >= {limits}[p + s], p + s, p))"""


def numbers(values: Iterable[float]) -> str:
    """A constant array of doubles: as one text, quicker to parse than many literals."""
    return f"cast(split('{','.join(map(repr, values))}', ',') as array<double>)"


@dataclass(frozen=True)
class Bands:
    """``limits``: where bands begin, ascending; the last one ends at ``top``."""

    limits: tuple[float, ...]
    top: float
    left: float
    right: float

    @property
    def array(self) -> str:
        return numbers(self.limits)

    def band(self, y: str) -> str:
        return step_of(y, self.array, len(self.limits))

    def covers(self, x: str, y: str) -> str:
        """False for places that no region can hold, and for NaN."""
        low = self.limits[0]
        return f"({x} between {self.left!r}D and {self.right!r}D and {y} >= {low!r}D and {y} < {self.top!r}D)"


NONE = Bands((0.0,), 0.0, 0.0, 0.0)


def fit_bands(edges: DataFrame, bands: int | None = None) -> tuple[Bands, int, float]:
    """Bands over upward edges, each with about sixteen ends of them inside, but so few
    that edges enter them n log n times in all at most, or a few times each. Besides, how
    often they do, and how many times the edges reach across the whole width.

    A height that many edges share is a limit itself, and ends on limits are in no
    band's inside. Level lines at equal distances are limits too, so that there are
    cells without borders however few these are. At most 4,096 limits, and as many lines
    as 64, come to the driver.
    """
    shares = numbers(k / MOST_BANDS for k in range(1, MOST_BANDS))
    total = edges.selectExpr("*", "explode(array(y1, y2)) as y").selectExpr(
        "count(*) div 2 as n",
        "min(y) as low",
        "max(y) as top",
        "min(least(x1, x2)) as left",
        "max(greatest(x1, x2)) as right",
        "sum(abs(x2 - x1)) / 2 as across",
        f"percentile_approx(y, {shares}, {8 * MOST_BANDS}) as found",
    ).first()
    if not total.n:
        return NONE, 0, 0.0
    wanted = bands or min(MOST_BANDS, max(1, 2 * total.n // ENDS))
    every = MOST_BANDS / wanted
    picked = {total.found[int(k * every) - 1] for k in range(1, wanted)}
    if not bands:
        picked |= {total.low + (total.top - total.low) * k / LINES for k in range(1, LINES)}
    limits = sorted({total.low, *picked} - {total.top}) or [total.low]
    held = Bands(tuple(limits), total.top, total.left, total.right)
    passed = edges.selectExpr(f"sum({held.band('y2')} - {held.band('y1')}) as passed").first().passed
    across = total.across / (total.right - total.left or 1.0)
    if bands:
        return held, total.n + passed, across
    every = max(1, math.ceil(passed / (total.n * max(4.0, math.log2(total.n)))))
    # of heights that many edges share all stay
    shared = {y for y, n in Counter(total.found).items() if 2 * n * len(limits) >= MOST_BANDS * every}
    left = tuple(y for k, y in enumerate(held.limits) if k % every == 0 or y in shared)
    return Bands(left, total.top, total.left, total.right), total.n + passed * len(left) // len(limits), across


def by_band(edges: DataFrame, held: Bands) -> DataFrame:
    """Upward edges once for each band they meet, with the stretch ``xa`` to ``xb`` they
    pass through there and the band's ``low`` and ``high`` limit."""
    low = f"{held.array}[band]"
    high = f"if(band + 1 < {len(held.limits)}, {held.array}[band + 1], {held.top!r}D)"

    def at(y: str) -> str:
        return f"if(y2 > y1, least(greatest(x1 + (x2 - x1) / (y2 - y1) * ({y} - y1), least(x1, x2)), greatest(x1, x2)), {{}})"

    enter, leave = at("greatest(y1, low)").format("x1"), at("least(y2, high)").format("x2")
    return (
        edges.selectExpr("*", f"explode_outer(sequence({held.band('y1')}, {held.band('y2')})) as band")
        .selectExpr("*", f"{low} as low", f"{high} as high")
        .selectExpr("*", f"{enter} as xe", f"{leave} as xl")
        .selectExpr(*edges.columns, "band", "low", "high", "least(xe, xl) as xa", "greatest(xe, xl) as xb")
    )


@dataclass(frozen=True)
class Cells:
    """``layout``: for each ``_band`` the ``_limits`` of its columns. ``cells``: for each
    ``_cell`` the ``_qx`` of a place in it and ``_parts``: region, its edges in the cell,
    and its winding number ``around`` that place less what those above it add. ``bytes``
    bounds the two."""

    bands: Bands
    columns: int
    layout: DataFrame
    cells: DataFrame
    bytes: int

    def column(self, x: str) -> str:
        return step_of(x, "_limits", self.columns)


def cell_key(band: str, column: str) -> str:
    return f"(cast({band} as bigint) * {1 << _SHIFT} + {column})"


def fit_cells(edges: DataFrame, bands: int | None = None, columns: int | None = None) -> Cells:
    """Cells over upward edges (``region``, ends, weight ``w``), as written tables.

    A band has as many columns as its edges fill with about four each, but so few that
    edges meet two or three of them on average.
    """
    held, entries, across = fit_bands(edges, bands)
    placed = by_band(edges, held)
    lines = 1
    if columns is None:
        fill = entries / (BEGUN * len(held.limits))
        columns, lines = int(max(1, min(MOST_COLUMNS, fill, 2 * entries / max(across, 1e-9)))), LINES
    shares = numbers(k / columns for k in range(columns))
    most = max(abs(v) for v in (held.left, held.right, 1e-300))
    layout, _ = written(
        placed.groupBy("band", "low", "high")
        .agg(
            F.expr(f"percentile_approx(xa, {shares}, 10000) as begun"),
            F.expr("min(xa) as first"),
            F.expr("max(xb) as last"),
        )
        .selectExpr(
            "band as _band",
            f"""array_sort(array_distinct(concat(begun, transform(sequence(0, {lines - 1}),
                k -> first + (last - first) * k / {lines}D)))) as _limits""",
            f"last + 0.01D * greatest(last - first, {most * 1e-6!r}D) as _end",
            f"low + (high - low) * {INNER!r}D as _qy",
        ),
        "layout",
    )
    margin = f"{most * 2.0**-40!r}D"
    end = "if(c + 1 < size(_limits), _limits[c + 1], _end)"
    known = f"transform(sequence(c0, c1), c -> _limits[c] + ({end} - _limits[c]) * {INNER!r}D)"
    met, _ = written(
        placed.repartition("band")
        .join(F.broadcast(layout), F.col("band") == F.col("_band"))
        .selectExpr(
            *edges.columns,
            "_band",
            "_limits",
            "_end",
            "_qy",
            f"{step_of(f'(xa - {margin})', '_limits', columns + lines)} as c0",
            f"{step_of(f'(xb + {margin})', '_limits', columns + lines)} as c1",
        )
        .selectExpr("region", f"{EDGE} as edge", "_band", "_qy", "c0", f"{known} as known"),
        "met",
    )
    # what an edge above the known place of its cell adds there is taken off at once
    under = f"""case when edge.x1 <= qx and qx < edge.x2 and not {left("edge", "qx", "_qy")} then edge.w
                     when edge.x2 <= qx and qx < edge.x1 and {left("edge", "qx", "_qy")} then -edge.w else 0L end"""
    own = met.selectExpr("*", "posexplode_outer(known) as (nth, qx)").selectExpr(
        "region", "_band", "c0 + nth as column", "qx", "edge", f"{under} as around"
    )
    # an edge at the height of the known places is to the right of those before column g
    passing = met.where("edge.y1 <= _qy and _qy < edge.y2").selectExpr(
        "region", "_band", "edge.w as w", f"c0 + size(filter(known, q -> {left('edge', 'q', '_qy')})) as g"
    )
    steps = passing.where("g > 0").groupBy("region", "_band", "g").agg(F.sum("w").alias("w"))
    over = "(partition by region, _band order by g desc)"
    around = steps.selectExpr(
        "region", "_band", "g", f"sum(w) over {over} as around", f"coalesce(lead(g) over {over}, 0) as after"
    ).where("around <> 0")
    inner = around.selectExpr(
        "region", "_band", "explode(sequence(after, g - 1)) as column", "null as qx", "null as edge", "around"
    )
    parts = (
        own.unionByName(inner)
        .groupBy("region", "_band", "column")
        .agg(F.min("qx").alias("qx"), F.collect_list("edge").alias("edges"), F.sum("around").alias("around"))
        .groupBy("_band", "column")
        .agg(F.min("qx").alias("_qx"), F.expr("collect_list(struct(struct(region) as of, around, edges)) as _parts"))
    )
    cells, _ = written(parts.selectExpr(f"{cell_key('_band', 'column')} as _cell", "_qx", "_parts"), "cells")
    sizes = layout.selectExpr(f"{ROW_BYTES} + 8 * size(_limits) as b").unionAll(
        cells.selectExpr(
            f"{ROW_BYTES} + aggregate(_parts, 0, (n, p) -> n + 2 * {EDGE_BYTES} + {EDGE_BYTES} * size(p.edges)) as b"
        )
    )
    bound = sizes.agg(F.sum("b")).first()[0] or 0
    return Cells(held, columns + lines, layout.select("_band", "_limits"), cells, bound)


def left(e: str, x: str, y: str) -> str:
    """Is a place, or if it is on the edge the one just above it, to the left of the edge?"""
    return f"({side(e, x, y)} >= if({e}.x1 < {e}.x2, 0, 1))"


def from_known(part: str, y: str, qx: str = "_qx") -> str:
    """The winding number of a part's region less what the part's edges to the right of a
    place at height y add: that of the known place, changed by the edges on the way from
    there, up or down and then level. No side needs computing: an edge that the way
    passes either way counts the same for both ways around it."""
    rising = f"e.x1 <= {qx} and {qx} < e.x2"
    falling = f"e.x2 <= {qx} and {qx} < e.x1"
    change = f"""case when {rising} then if({y} < e.y2, -e.w, 0)
                      when {falling} then if({y} < e.y1, e.w, 0)
                      when e.y1 <= {y} and {y} < e.y2 and {qx} < e.x1 then -e.w else 0 end"""
    return f"aggregate({part}.edges, {part}.around, (n, e) -> n + {change})"
