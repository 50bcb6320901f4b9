"""Trajectories and lines: lengths, zones they cross, interpolation in time, and resampling between cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, in_polygon, segments_cross


def segments(points: DataFrame, keys: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """(keys, x1, y1, x2, y2): consecutive points of each line."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = points.select(*keys, F.col(x).alias("x1"), F.col(y).alias("y1"), F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2"))
    return out.where("x2 IS NOT NULL")


def path_lengths(points: DataFrame, keys: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Length in km and number of steps of each line."""
    km = haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return segments(points, keys, order, x, y).groupBy(*keys).agg(F.sum(km).alias("km"), F.count("*").alias("steps"))


def crossed(points: DataFrame, zones: DataFrame, keys: Sequence[str], order: str, x: str, y: str, zone: str, tile: float = 1.0) -> DataFrame:
    """(zone, n_lines): lines that touch each zone, by a vertex inside it or a segment over its outline.

    Segments and zones meet on the square tiles that their boxes touch.
    """
    cell = lambda v: F.floor(v / tile)
    span = lambda a, b: F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b)))
    s = segments(points, keys, order, x, y).withColumn("_tx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("_ty", F.explode(span(F.col("y1"), F.col("y2"))))
    low = lambda k: F.array_min(F.transform("edges", lambda e: F.least(e[k + "1"], e[k + "2"])))
    high = lambda k: F.array_max(F.transform("edges", lambda e: F.greatest(e[k + "1"], e[k + "2"])))
    z = zones.select(zone, "edges").withColumn("_tx", F.explode(F.sequence(cell(low("x")), cell(high("x"))))).withColumn("_ty", F.explode(F.sequence(cell(low("y")), cell(high("y")))))
    own = (F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    over = F.exists("edges", lambda e: segments_cross(own, (e.x1, e.y1, e.x2, e.y2)))
    touches = over | in_polygon(F.col("x1"), F.col("y1"), F.col("edges")) | in_polygon(F.col("x2"), F.col("y2"), F.col("edges"))
    return s.join(z, ["_tx", "_ty"]).where(touches).select(*keys, zone).distinct().groupBy(zone).agg(F.count("*").alias("n_lines"))


def at_times(series: DataFrame, wanted: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Linear interpolation of hourly values at the times of `wanted` (keys, t in hours)."""
    base = wanted.withColumns({"_h": F.floor(t).cast("int"), "_f": F.col(t) - F.floor(t)})
    low = series.select(*keys, F.col(t).cast("int").alias("_h"), F.col(value).alias("_low"))
    high = series.select(*keys, (F.col(t).cast("int") - 1).alias("_h"), F.col(value).alias("_high"))
    joined = base.join(low, [*keys, "_h"], "left").join(high, [*keys, "_h"], "left")
    mixed = F.when(F.col("_f") == 0, F.col("_low")).otherwise(F.col("_low") * (1 - F.col("_f")) + F.col("_high") * F.col("_f"))
    return joined.select(*wanted.columns, mixed.alias(value))


def bilinear(points: DataFrame, cells: DataFrame, key: Sequence[str], x: Column, y: Column, value: str) -> DataFrame:
    """Value at positions in cell units (cell centres at whole numbers) from the four cells around, by equi-joins;
    NULL where one is missing."""
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    corners = F.array(*(F.struct((y0 + a).alias("r"), (x0 + b).alias("c"), ((1 - F.abs(y - y0 - a)) * (1 - F.abs(x - x0 - b))).alias("w")) for a in (0, 1) for b in (0, 1)))
    spread = points.select(*key, F.explode(corners).alias("_k")).select(*key, "_k.r", "_k.c", "_k.w").where("w > 0")
    met = spread.join(cells.select("r", "c", value), ["r", "c"], "left")
    out = met.groupBy(*key).agg(F.sum(F.col(value) * F.col("w")).alias("_s"), F.count(value).alias("_n"), F.count("*").alias("_k"))
    return out.select(*key, F.when(F.col("_n") == F.col("_k"), F.col("_s")).alias(value))


def phase_gradient(cells: DataFrame, phase: str, size: int, least: float = 0.25) -> DataFrame:
    """Mean phase step along rows in tiles of size by size cells, safe against wraps: the angle of summed turns. Tiles
    with less than `least` of their cells give NULL."""
    w = Window.partitionBy("r").orderBy("c")
    step = F.when(F.lead("c").over(w) == F.col("c") + 1, F.lead(phase).over(w) - F.col(phase))
    tiles = cells.withColumn("_d", step).groupBy(F.floor(F.col("r") / size).cast("int").alias("tr"), F.floor(F.col("c") / size).cast("int").alias("tc"))
    out = tiles.agg(F.sum(F.sin("_d")).alias("_s"), F.sum(F.cos("_d")).alias("_c"), F.count("_d").alias("n"))
    return out.select("tr", "tc", "n", F.when(F.col("n") >= least * size * size, F.atan2("_s", "_c")).alias("step"))


def coherence(cells: DataFrame, size: int) -> DataFrame:
    """Coherence of two complex images (re1, im1, re2, im2) in blocks, with the floor that noise alone reaches."""
    re = F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2")
    im = F.col("im1") * F.col("re2") - F.col("re1") * F.col("im2")
    power = lambda k: F.avg(F.col(f"re{k}") * F.col(f"re{k}") + F.col(f"im{k}") * F.col(f"im{k}"))
    blocks = cells.groupBy(F.floor(F.col("r") / size).cast("int").alias("br"), F.floor(F.col("c") / size).cast("int").alias("bc"))
    out = blocks.agg(F.hypot(F.avg(re), F.avg(im)).alias("_x"), power(1).alias("_p"), power(2).alias("_q"), F.count("*").alias("n"))
    return out.select("br", "bc", "n", F.try_divide(F.col("_x"), F.sqrt(F.col("_p") * F.col("_q"))).alias("coherence"), F.sqrt(F.pi() / (4 * F.col("n"))).alias("noise_floor"))


def contour(cells: DataFrame, value: str, level: float) -> DataFrame:
    """(r, c, x1, y1, x2, y2): segments of a contour within each square of four cells, in cell units, by linear
    interpolation along its sides; saddles are split by the mean of the four."""
    right, down = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    q = cells.select("r", "c", F.col(value).alias("a"), F.when(F.lead("c").over(right) == F.col("c") + 1, F.lead(value).over(right)).alias("b"), F.when(F.lead("r").over(down) == F.col("r") + 1, F.lead(value).over(down)).alias("d"))
    q = q.withColumn("e", F.when(F.lead("r").over(down) == F.col("r") + 1, F.lead("b").over(down))).where("a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL")
    a, b, d, e, r, c = (F.col(k) for k in ("a", "b", "d", "e", "r", "c"))
    along = lambda p, s: (level - p) / F.when(s != p, s - p)
    top, bottom = F.struct((c + along(a, b)).alias("x"), r.cast("double").alias("y")), F.struct((c + along(d, e)).alias("x"), (r + 1.0).alias("y"))
    left, side = F.struct(c.cast("double").alias("x"), (r + along(a, d)).alias("y")), F.struct((c + 1.0).alias("x"), (r + along(b, e)).alias("y"))
    case = (a > level).cast("int") + (b > level).cast("int") * 2 + (e > level).cast("int") * 4 + (d > level).cast("int") * 8
    high = (a + b + d + e) / 4 > level
    one = lambda p, s: F.array(F.struct(p.alias("p"), s.alias("s")))
    two = lambda p, s, t, u: F.array(F.struct(p.alias("p"), s.alias("s")), F.struct(t.alias("p"), u.alias("s")))
    apart, across = two(left, top, bottom, side), two(top, side, left, bottom)
    lines = F.when(case.isin(1, 14), one(left, top)).when(case.isin(2, 13), one(top, side)).when(case.isin(3, 12), one(left, side)).when(case.isin(4, 11), one(side, bottom))
    lines = lines.when(case.isin(6, 9), one(top, bottom)).when(case.isin(7, 8), one(left, bottom)).when(case == 5, F.when(high, across).otherwise(apart)).when(case == 10, F.when(high, apart).otherwise(across))
    out = q.select("r", "c", F.explode(lines).alias("l"))
    return out.select("r", "c", F.col("l.p.x").alias("x1"), F.col("l.p.y").alias("y1"), F.col("l.s.x").alias("x2"), F.col("l.s.y").alias("y2"))
