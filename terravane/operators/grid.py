"""Neighbourhoods on a grid of cells: focal statistics, box filters and gradients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import QUEEN, neighbours


def focal(cells: DataFrame, value: str, how: str = "median", offsets: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    """Statistic of each cell's own value and those around it; cells that are missing count for nothing."""
    reduce = {"median": F.median, "min": F.min, "max": F.max, "mean": F.avg}[how]
    return neighbours(cells, value, [(0, 0), *offsets]).groupBy("r", "c").agg(reduce("other").alias(how))


def opened(cells: DataFrame, value: str, offsets: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    """Minimum, then maximum: bright specks go, edges stay."""
    low = focal(cells, value, "min", offsets)
    return focal(low.withColumnRenamed("min", value), value, "max", offsets).withColumnRenamed("max", value)


def box_mean(cells: DataFrame, value: str, reach: int, weight: str | None = None) -> DataFrame:
    """Mean over squares of 2*reach+1 cells, optionally weighted, as sums along rows and then along columns."""
    w = F.col(weight) if weight else F.lit(1.0)
    known = F.col(value).isNotNull()
    parts = cells.select("r", "c", F.when(known, F.col(value) * w).otherwise(0.0).alias("_s"), F.when(known, w).otherwise(0.0).alias("_w"))
    along = Window.partitionBy("r").orderBy("c").rangeBetween(-reach, reach)
    rows = parts.select("r", "c", F.sum("_s").over(along).alias("_s"), F.sum("_w").over(along).alias("_w"))
    down = Window.partitionBy("c").orderBy("r").rangeBetween(-reach, reach)
    return rows.select("r", "c", F.sum("_s").over(down).alias("_s"), F.sum("_w").over(down).alias("_w")).select("r", "c", F.try_divide("_s", "_w").alias("mean"))


def slope_degrees(cells: DataFrame, height: str, metres: float) -> DataFrame:
    """Slope from central differences, one-sided along the frame."""
    by_row, by_column = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")

    def gradient(w, axis: str):
        ahead, behind = F.lead(height).over(w), F.lag(height).over(w)
        span = F.coalesce(F.lead(axis).over(w), F.col(axis)) - F.coalesce(F.lag(axis).over(w), F.col(axis))
        return F.try_divide(F.coalesce(ahead, F.col(height)) - F.coalesce(behind, F.col(height)), span * metres)

    g = cells.select("r", "c", gradient(by_row, "c").alias("gx"), gradient(by_column, "r").alias("gy"))
    return g.select("r", "c", F.degrees(F.atan(F.hypot("gx", "gy"))).alias("slope"))


def local_peaks(cells: DataFrame, value: str, bound: float) -> DataFrame:
    """Cells at or above a bound that no neighbour exceeds."""
    top = focal(cells, value, "max").withColumnRenamed("max", "_top")
    return cells.join(top, ["r", "c"]).where((F.col(value) >= bound) & (F.col(value) == F.col("_top"))).select("r", "c", value)


def unwrapped(series: DataFrame, keys: Sequence[str], order: str, phase: str) -> DataFrame:
    """Phase along transects without its jumps of full turns: steps wrapped to [-pi, pi) and summed up."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(phase) - F.lag(phase).over(w)
    turn = 2 * F.pi()
    wrapped = step - turn * F.floor((step + F.pi()) / turn)
    steps = series.withColumn("_step", F.coalesce(wrapped, F.col(phase)))
    return steps.withColumn("unwrapped", F.sum("_step").over(w)).drop("_step")
