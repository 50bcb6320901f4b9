"""Zones, masks and grids laid over each other. Counts are summed on the grid they were counted on; only means and classes are sampled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_polygon
from .zonal import grid_index


@dataclass(frozen=True)
class Grid:
    """columns by rows cells of dx by dy degrees; row 0 and column 0 begin at (x0, y0)."""

    x0: float
    y0: float
    dx: float
    dy: float
    columns: int
    rows: int

    def centre(self) -> tuple[Column, Column]:
        return (F.col("c") + 0.5) * self.dx + self.x0, (F.col("r") + 0.5) * self.dy + self.y0

    def place(self, x: Column, y: Column) -> dict[str, Column]:
        """Row and column of the cell that holds a point, clipped to the grid."""
        return {"r": grid_index(y, self.y0, self.dy, self.rows), "c": grid_index(x, self.x0, self.dx, self.columns)}

    def cells(self, spark: SparkSession) -> DataFrame:
        whole = spark.range(self.rows * self.columns)
        return whole.select(F.floor(F.col("id") / self.columns).cast("int").alias("r"), (F.col("id") % self.columns).cast("int").alias("c"))


def rasterized(zones: DataFrame, grid: Grid, zone: str, all_touched: bool = False) -> DataFrame:
    """(r, c, zone): the cells whose centre lies in a zone or, with all_touched, that a zone meets anywhere; where zones
    overlap, the least one. Each zone lists the cells of its own box, so no zone meets cells far away."""
    bound = lambda f, pick, k: f(F.transform("edges", lambda e: pick(e[k + "1"], e[k + "2"])))
    spread = zones
    for name, k, origin, step, n in (("r", "y", grid.y0, grid.dy, grid.rows), ("c", "x", grid.x0, grid.dx, grid.columns)):
        first = F.floor((bound(F.array_min, F.least, k) - origin) / step) - 1
        last = F.floor((bound(F.array_max, F.greatest, k) - origin) / step)
        first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(n - 1)).cast("int")
        spread = spread.withColumn("_ok", first <= last).where("_ok").withColumn(name, F.explode(F.sequence(first, last)))
    x, y = grid.centre()
    met = in_polygon(x, y, F.col("edges"))
    if all_touched:
        w, s = F.col("c") * grid.dx + grid.x0, F.col("r") * grid.dy + grid.y0
        met = met | F.exists("edges", lambda e: _meets_box(e, w, s, w + grid.dx, s + grid.dy))
    return spread.where(met).groupBy("r", "c").agg(F.min(zone).alias(zone))


def _meets_box(e: Column, w: Column, s: Column, east: Column, north: Column) -> Column:
    """Whether a segment meets a box: their extents overlap, and the box's corners aren't all on one side of it."""
    side = lambda x, y: (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)
    corners = [side(w, s), side(east, s), side(east, north), side(w, north)]
    over = (F.least(e.x1, e.x2) <= east) & (F.greatest(e.x1, e.x2) >= w) & (F.least(e.y1, e.y2) <= north) & (F.greatest(e.y1, e.y2) >= s)
    return over & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def sampled(cells: DataFrame, grid: Grid, field: DataFrame, coarse: Grid, columns: Sequence[str], keep: bool = True) -> DataFrame:
    """cells (r, c, ...) of one grid with columns of the cell of a coarser field that holds their centre."""
    x, y = grid.centre()
    at = coarse.place(x, y)
    named = field.select(F.col("r").alias("_r"), F.col("c").alias("_c"), *columns)
    return cells.withColumns({"_r": at["r"], "_c": at["c"]}).join(named, ["_r", "_c"], "left" if keep else "inner").drop("_r", "_c")


def peat(depth: Column | None = None, carbon: Column | None = None, least_carbon: float = 30.0) -> Column:
    """Whether a cell is peat: by a depth above 0, or by soil carbon of `least_carbon` at least. NULL where nothing is known."""
    return depth > 0 if depth is not None else carbon >= least_carbon


def block_factor(rows: int, columns: int, most: int, limit: int = 16) -> int:
    """Least power of two, up to `limit`, by which a grid must be coarsened to hold `most` cells at most."""
    factor = 1
    while factor < limit and -(-rows // factor) * -(-columns // factor) > most:
        factor *= 2
    return factor


def coarsened(cells: DataFrame, value: str, factor: int) -> DataFrame:
    """Means over blocks of factor by factor cells, ragged ones at the edge among them."""
    block = lambda k: F.floor(F.col(k) / factor).cast("int").alias(k)
    return cells.groupBy(block("r"), block("c")).agg(F.avg(value).alias(value))


def aligned(a: DataFrame, b: DataFrame, rows: int, columns: int, how: str = "inner") -> DataFrame:
    """Cells of a with those of b on the same lattice, whose cell (r, c) is a's cell (r + rows, c + columns)."""
    moved = b.withColumns({"r": (F.col("r") + rows).cast("int"), "c": (F.col("c") + columns).cast("int")})
    return a.join(moved, ["r", "c"], how)


def lattice_offset(a: tuple[float, float], b: tuple[float, float], step: float, slack: float = 0.01) -> tuple[int, int]:
    """Rows and columns from origin a to origin b (x, y); refuses origins that don't lie on one lattice."""
    moves = (b[1] - a[1]) / step, (b[0] - a[0]) / step
    if any(abs(m - round(m)) > slack for m in moves):
        raise ValueError(f"origins {a} and {b} aren't a whole number of cells of {step} apart")
    return round(moves[0]), round(moves[1])


def tiles(boxes: DataFrame, size: float, w: str = "w", s: str = "s", e: str = "e", n: str = "n") -> DataFrame:
    """Boxes cut into tiles of up to `size` degrees from their south-western corner: columns tw, ts, te, tn."""
    steps = lambda low, high: F.sequence(F.lit(0), F.greatest(F.ceil((F.col(high) - F.col(low)) / size).cast("int") - 1, F.lit(0)))
    cut = boxes.withColumn("_i", F.explode(steps(w, e))).withColumn("_j", F.explode(steps(s, n)))
    start = {"tw": F.col(w) + F.col("_i") * size, "ts": F.col(s) + F.col("_j") * size}
    return cut.withColumns(start).withColumns({"te": F.least(F.col("tw") + size, F.col(e)), "tn": F.least(F.col("ts") + size, F.col(n))}).drop("_i", "_j")


def crop_box(cells: DataFrame, inside: Column, pad: int, rows: int, columns: int) -> DataFrame:
    """One row: first and last row and column of the cells that a mask holds, with `pad` cells around, within the grid."""
    hit = lambda k: F.when(inside, F.col(k))
    box = cells.agg(*(f(hit(k)).alias(f"{k}{n}") for k in "rc" for f, n in ((F.min, 0), (F.max, 1))))
    low = lambda k: F.when(F.col(k).isNotNull(), F.greatest(F.col(k) - pad, F.lit(0))).alias(k)
    high = lambda k, n: F.when(F.col(k).isNotNull(), F.least(F.col(k) + pad, F.lit(n - 1))).alias(k)
    return box.select(low("r0"), high("r1", rows), low("c0"), high("c1", columns))


def centres(cells: DataFrame, grid: Grid, value: str) -> DataFrame:
    """Points (lon, lat) in the middle of cells whose value isn't 0."""
    x, y = grid.centre()
    return cells.where(F.col(value) != 0).select(x.alias("lon"), y.alias("lat"), value)


def mosaic(frames: DataFrame, value: str, order: str) -> DataFrame:
    """Cells of overlapping frames as one: their mean, the value of the first frame by `order`, and how many frames hold one."""
    known = frames.where(F.col(value).isNotNull())
    return known.groupBy("r", "c").agg(F.avg(value).alias("mean"), F.min_by(value, order).alias("first"), F.count("*").alias("frames"))


def blended(cells: DataFrame, value: str, kernel: Sequence[float]) -> DataFrame:
    """Weighted mean over a square of neighbours with a separable kernel, of what lies on the grid: the weights are shared anew at its edge."""
    half = len(kernel) // 2
    steps = F.array(*(F.struct(F.lit(i - half).alias("dr"), F.lit(j - half).alias("dc"), F.lit(float(a * b)).alias("wt")) for i, a in enumerate(kernel) for j, b in enumerate(kernel)))
    sent = cells.where(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("_v"), F.explode(steps).alias("_k"))
    sent = sent.groupBy((F.col("r") + F.col("_k.dr")).alias("r"), (F.col("c") + F.col("_k.dc")).alias("c")).agg((F.sum(F.col("_v") * F.col("_k.wt")) / F.sum("_k.wt")).alias(value))
    return cells.select("r", "c").join(sent, ["r", "c"])
