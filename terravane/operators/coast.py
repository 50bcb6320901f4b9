"""Shorelines: lines of a contour without the frame, baselines along them, transects across them, and what is sea."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import border_regions, regions
from .grid import focal
from .joins import QUEEN, ROOK, root_of_squares


def open_lines(points: DataFrame, ring: str, order: str, frame: tuple[float, float, float, float], least: float, slack: float = 1e-9) -> DataFrame:
    """Segments (ring, line, x1, y1, x2, y2, len) of contours (ring, order, x, y) as lines: segments along the frame (w, s, e, n) are
    dropped, which cuts a ring into lines, and lines shorter than `least` go."""
    w, s, e, n = frame
    at = Window.partitionBy(ring).orderBy(order)
    seg = points.select(ring, F.col(order).alias("_i"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(at).alias("x2"), F.lead("y").over(at).alias("y2")).where("x2 IS NOT NULL")
    on = lambda a, b, v: (F.abs(F.col(a) - v) <= slack) & (F.abs(F.col(b) - v) <= slack)
    cut = (on("x1", "x2", w) | on("x1", "x2", e) | on("y1", "y2", s) | on("y1", "y2", n)).cast("int")
    line = F.sum(cut).over(Window.partitionBy(ring).orderBy("_i"))
    seg = seg.withColumns({"_cut": cut, "line": line, "len": root_of_squares(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))}).where("_cut = 0")
    whole = F.sum("len").over(Window.partitionBy(ring, "line"))
    return seg.withColumn("_whole", whole).where(F.col("_whole") >= least).drop("_cut", "_whole")


def baseline(segments: DataFrame, keys: Sequence[str], spacing: float, reach: int = 2) -> DataFrame:
    """Points (keys, p, x, y, nx, ny) every `spacing` along lines of segments, with unit normals to the left of the direction
    averaged over `reach` segments on either side."""
    order = Window.partitionBy(*keys).orderBy("_i")
    near = order.rowsBetween(-reach, reach)
    s = segments.withColumn("_end", F.sum("len").over(order)).withColumn("_start", F.col("_end") - F.col("len"))
    dx, dy = F.sum(F.col("x2") - F.col("x1")).over(near), F.sum(F.col("y2") - F.col("y1")).over(near)
    s = s.withColumns({"_dx": dx, "_dy": dy}).where("len > 0")
    first, last = F.ceil(F.col("_start") / spacing), F.ceil(F.col("_end") / spacing) - 1
    s = s.where(first <= last).withColumn("p", F.explode(F.sequence(first, last)))
    part = (F.col("p") * spacing - F.col("_start")) / F.col("len")
    along = lambda a: F.col(a + "1") + (F.col(a + "2") - F.col(a + "1")) * part
    norm = root_of_squares(F.col("_dx"), F.col("_dy"))
    return s.select(*keys, "p", along("x").alias("x"), along("y").alias("y"), F.try_divide(-F.col("_dy"), norm).alias("nx"), F.try_divide("_dx", norm).alias("ny"))


def seaward(points: DataFrame, keys: Sequence[str], sea: DataFrame, step: float, cell: float) -> DataFrame:
    """points with normals turned to the sea by a vote along each line: of the places `step` off on either side, more
    of those on the sea's side lie in cells (r, c) of `sea`. A tie keeps the left side."""
    votes = points
    wet = sea.select("r", "c").distinct()
    for sign, name in ((1, "_left"), (-1, "_right")):
        place = lambda a: F.floor((F.col(a) + sign * step * F.col(f"n{a}")) / cell).cast("int")
        marked = wet.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.lit(1).alias(name))
        votes = votes.withColumns({"_r": place("y"), "_c": place("x")}).join(marked, ["_r", "_c"], "left").drop("_r", "_c")
    sums = votes.groupBy(*keys).agg(F.when(F.sum(F.coalesce("_right", F.lit(0))) > F.sum(F.coalesce("_left", F.lit(0))), -1).otherwise(1).alias("_sign"))
    turned = points.join(sums, list(keys))
    return turned.withColumns({"nx": F.col("nx") * F.col("_sign"), "ny": F.col("ny") * F.col("_sign")}).drop("_sign")


def crossings(transects: DataFrame, key: str, shores: DataFrame, epoch: str, length: float, tile: float) -> DataFrame:
    """(key, epoch, distance): where transects (key, x, y, nx, ny) of a length cross shorelines (epoch, x1, y1, x2, y2), the one
    farthest out if they cross several times. Both sides meet by the tiles that their boxes touch, once for each
    different transect and stroke: repeated ones get their distances by their places."""

    def spread(df: DataFrame, xs: Sequence[Column], ys: Sequence[Column]) -> DataFrame:
        at = lambda f, v: F.floor(f(*v) / tile)
        return df.withColumn("_tx", F.explode(F.sequence(at(F.least, xs), at(F.greatest, xs)))).withColumn("_ty", F.explode(F.sequence(at(F.least, ys), at(F.greatest, ys))))

    c = F.col
    place = ["x", "y", "nx", "ny"]
    # x + 0.0 makes 0.0 of -0.0
    rays = transects.select(key, *((c(k) + 0.0).alias(k) for k in place)).dropna(subset=place)
    strokes = shores.select(epoch, "x1", "y1", "x2", "y2").distinct()
    ray = spread(rays.select(*place).distinct(), [c("x"), c("x") + c("nx") * length], [c("y"), c("y") + c("ny") * length])
    shore = spread(strokes, [c("x1"), c("x2")], [c("y1"), c("y2")])
    met = ray.join(shore, ["_tx", "_ty"])
    ex, ey = c("x2") - c("x1"), c("y2") - c("y1")
    det = c("nx") * ey - c("ny") * ex
    t = F.try_divide((c("x1") - c("x")) * ey - (c("y1") - c("y")) * ex, det)
    u = F.try_divide((c("x1") - c("x")) * c("ny") - (c("y1") - c("y")) * c("nx"), det)
    hit = met.select(*place, epoch, t.alias("_t"), u.alias("_u")).where((c("_t") >= 0) & (c("_t") <= length) & (c("_u") >= 0) & (c("_u") <= 1))
    farthest = hit.groupBy(*place, epoch).agg(F.max("_t").alias("_t"))
    return rays.join(farthest, place).groupBy(key, epoch).agg(F.max("_t").alias("distance"))


def coast_change(cells: DataFrame, before: Column, after: Column, least: int) -> DataFrame:
    """(r, c, kind) of cells that were land and are none (erosion) or the other way round (accretion), in regions of `least` cells or more."""
    kind = F.when(before & ~after, "erosion").when(~before & after, "accretion")
    marked = cells.withColumn("kind", kind).where("kind IS NOT NULL").select("r", "c", "kind")
    out = None
    for name in ("erosion", "accretion"):
        own = regions(marked.where(F.col("kind") == name).select("r", "c"), QUEEN)
        sizes = own.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
        part = own.join(sizes, "label").select("r", "c", F.lit(name).alias("kind"))
        out = part if out is None else out.union(part)
    return out


def filled(cells: DataFrame, grid: DataFrame, rows: int, columns: int) -> DataFrame:
    """(r, c) of a mask with its holes: cells of the grid outside it from which no way leads to the frame."""
    outside = grid.select("r", "c").join(cells.select("r", "c"), ["r", "c"], "left_anti")
    return grid.select("r", "c").join(border_regions(outside, rows, columns, ROOK), ["r", "c"], "left_anti")


def closed(cells: DataFrame, value: str, offsets: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    """Maximum, then minimum: gaps close, edges stay."""
    high = focal(cells, value, "max", offsets).withColumnRenamed("max", value)
    return focal(high, value, "min", offsets).withColumnRenamed("min", value)


def central_region(cells: DataFrame, row: float, column: float, reach: float) -> DataFrame:
    """(r, c) of the region that most cells within `reach` of a centre belong to, the least label among equals."""
    own = regions(cells, QUEEN)
    near = own.where(F.hypot(F.col("r") - row, F.col("c") - column) <= reach)
    best = near.groupBy("label").agg(F.count("*").alias("_n")).agg(F.max_by("label", F.struct("_n", -F.col("label"))).alias("label"))
    return own.join(F.broadcast(best), "label").select("r", "c")


def shore_length(sea: DataFrame, land: DataFrame, size: float) -> DataFrame:
    """One row: areas of sea and land, and the length of the edges between them, for square cells."""
    steps = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ROOK))
    sides = sea.select("r", "c", F.explode(steps).alias("_d")).select((F.col("r") + F.col("_d.dr")).alias("r"), (F.col("c") + F.col("_d.dc")).alias("c"))
    met = sides.join(land.select("r", "c"), ["r", "c"]).agg((F.count("*") * size).alias("length"))
    area = lambda df, name: df.agg((F.count("*") * size * size).alias(name))
    return area(sea, "sea").crossJoin(area(land, "land")).crossJoin(met)  # one row each


def shifted_epochs(wanted: DataFrame, epoch: str, available: DataFrame, year: str, pad: int = 2) -> DataFrame:
    """(epoch, used): for each wanted epoch the nearest year with data at most `pad` years away, the earlier of two equally near ones; NULL if there is none."""
    years = available.select(F.col(year).cast("long").alias("_y")).distinct()
    reach = wanted.select(F.col(epoch).cast("long").alias("epoch")).distinct()
    tried = reach.withColumn("_y", F.explode(F.sequence(F.col("epoch") - pad, F.col("epoch") + pad)))
    best = tried.join(years, "_y").groupBy("epoch").agg(F.min(F.struct(F.abs(F.col("_y") - F.col("epoch")).alias("d"), F.col("_y").alias("y"))).alias("_b"))
    return reach.join(best, "epoch", "left").select("epoch", F.col("_b.y").alias("used"))


def transects_of_lines(points: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """(key, x, y, nx, ny, length): transects given as lines, such as those of a file: from a line's first point towards its last. A line without an extent gives none."""
    place = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = points.groupBy(key).agg(F.min_by(place, order).alias("a"), F.max_by(place, order).alias("b"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    out = ends.select(key, F.col("a.x").alias("x"), F.col("a.y").alias("y"), dx.alias("_dx"), dy.alias("_dy"), F.hypot(dx, dy).alias("length")).where("length > 0")
    return out.select(key, "x", "y", (F.col("_dx") / F.col("length")).alias("nx"), (F.col("_dy") / F.col("length")).alias("ny"), "length")
