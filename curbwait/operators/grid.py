"""A grid over region borders, and the borders by its bands and cells.

Cells and bands are computed for edges and points by the same monotonic floor.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARGIN = 0.01  # of a cell; rounding in clipping an edge to a band is far below it
EDGE_BYTES = 64
CELL_BYTES = 96


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    x1: float
    y1: float
    columns: int
    bands: int

    @property
    def width(self) -> float:
        return (self.x1 - self.x0) / self.columns or 1.0

    @property
    def height(self) -> float:
        return (self.y1 - self.y0) / self.bands or 1.0

    def column(self, x: str) -> str:
        return _step(x, self.x0, self.width, self.columns)

    def band(self, y: str) -> str:
        return _step(y, self.y0, self.height, self.bands)

    def cell(self, column: str, band: str) -> str:
        return f"({band} * {self.columns} + {column})"

    def covers(self, x: str, y: str) -> str:
        """False for points beyond the grid and for NaN."""
        return (
            f"({x} between {self.x0!r}D and {self.x1!r}D"
            f" and {y} between {self.y0!r}D and {self.y1!r}D)"
        )


def _step(value: str, start: float, size: float, steps: int) -> str:
    return f"greatest(0, least(floor(({value} - ({start!r}D)) / {size!r}D), {steps - 1}))"


def _power_of_two(wanted: float, least: int) -> int:
    return max(least, 2 ** math.ceil(math.log2(wanted)))


def fit_grid(
    zone_edges: DataFrame, by: str, columns: int | None = None, bands: int | None = None
) -> tuple[Grid, float]:
    """A grid over the edges, and a bound on the bytes of an index on it.

    By default it is as fine as the edges are many, without an upper limit: bands to
    hold about sixteen edges that start there, and columns to leave a border few of
    the cells.

    The bound follows from extents alone: an edge enters the bands its height
    reaches, and a region's cells lie in the boxes around its zones. Rings are
    closed, so the starts of their edges span the box.
    """
    boxes = zone_edges.groupBy(by, "zone").agg(
        F.expr("count(*) as n"),
        F.expr("sum(abs(y2 - y1)) as climb"),
        F.expr("min(x1) as left"),
        F.expr("min(y1) as low"),
        F.expr("max(x1) as right"),
        F.expr("max(y1) as high"),
    )
    total = boxes.selectExpr(
        "count(*) as zones",
        "sum(n) as n",
        "sum(climb) as climb",
        "min(left) as left",
        "min(low) as low",
        "max(right) as right",
        "max(high) as high",
        "sum(right - left) as across",
        "sum(high - low) as up",
        "sum((right - left) * (high - low)) as boxes",
    ).first()
    if not total.n:
        return Grid(0.0, 0.0, 0.0, 0.0, 1, 1), 0.0
    bands = bands or _power_of_two(total.n / 16, 64)
    columns = columns or _power_of_two(2 * math.sqrt(total.n), 64)
    grid = Grid(total.left, total.low, total.right, total.high, columns, bands)
    entries = 2 * total.n + total.climb / grid.height
    cells = (
        total.boxes / (grid.width * grid.height)
        + 2 * (total.across / grid.width + total.up / grid.height)
        + 4 * total.zones
    )
    return grid, entries * EDGE_BYTES + cells * CELL_BYTES


def upward(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges with their lower end first, as lookups compare them, and the weight ``w``:
    the zones more on their left than on their right."""
    falls = "(y1 > y2 or (y1 = y2 and x1 > x2))"
    return edges.selectExpr(
        *keys,
        f"if({falls}, x2, x1) as x1",
        f"if({falls}, y2, y1) as y1",
        f"if({falls}, x1, x2) as x2",
        f"if({falls}, y1, y2) as y2",
        f"if({falls}, -net, net) as w",
    )


def edges_by_band(edges: DataFrame, grid: Grid) -> DataFrame:
    """Upward edges once per band they reach, with the columns ``c0`` to ``c1``
    they pass through there, a margin to each side."""
    slack_x, slack_y = grid.width * MARGIN, grid.height * MARGIN
    floor_y = f"{grid.y0!r}D + band * {grid.height!r}D"
    enter = f"greatest(y1, {floor_y} - {slack_y!r}D)"
    leave = f"least(y2, {floor_y} + {grid.height + slack_y!r}D)"
    return (
        edges.selectExpr(
            "*", f"explode_outer(sequence({grid.band('y1')}, {grid.band('y2')})) as band"
        )
        .selectExpr(
            "*",
            f"if(y2 > y1, x1 + (x2 - x1) / (y2 - y1) * ({enter} - y1), x1) as xa",
            f"if(y2 > y1, x1 + (x2 - x1) / (y2 - y1) * ({leave} - y1), x2) as xb",
        )
        .selectExpr(
            *edges.columns,
            "band",
            f"{grid.column(f'(least(xa, xb) - {slack_x!r}D)')} as c0",
            f"{grid.column(f'(greatest(xa, xb) + {slack_x!r}D)')} as c1",
        )
    )


def border_runs(edges: DataFrame, grid: Grid) -> DataFrame:
    """One row per region and run: a run of a band is a stretch of columns from ``run``
    to ``run_end`` that borders of any region pass through. Holds the region's edges
    there, its winding number ``beyond`` the right end, and ``next_run``, where its
    border is met again.

    No border passes between two runs, so the number there is what the region's edges
    that cross the band's middle line up to the run's end take from it. One shuffle by
    band serves all the windows and groups; a band holds some sixteen edges that start
    in it, and those that pass.
    """
    in_order = "partition by band order by c0, c1 rows between unbounded preceding"
    middle = f"{grid.y0!r}D + (band + 0.5D) * {grid.height!r}D"
    along = "(partition by region, band order by run)"
    return (
        edges_by_band(upward(edges, "region"), grid)
        .selectExpr("*", f"max(c1) over ({in_order} and 1 preceding) as reached")
        .selectExpr(
            "*",
            f"""max(if(reached is null or c0 > reached + 1, c0, null))
                over ({in_order} and current row) as run""",
        )
        .selectExpr("*", "max(c1) over (partition by band, run) as run_end")
        .groupBy("region", "band", "run", "run_end")
        .agg(
            F.expr("collect_list(struct(x1, y1, x2, y2, w)) as edges"),
            F.expr(f"sum(if(y1 <= {middle} and {middle} < y2, w, 0)) as crossed"),
        )
        .selectExpr(
            "region",
            "band",
            "run",
            "run_end",
            "edges",
            f"-sum(crossed) over {along} as beyond",
            f"lead(run) over {along} as next_run",
        )
    )
