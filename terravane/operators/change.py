"""Change between periods, and what composites of several dates tell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import METHODS, Bands, index
from .composite import CELL

OPTICAL = ("green", "red", "nir", "swir1", "swir2", "tir")


def optical_change(obs: DataFrame, split: str, method: str = "NDVI", min_obs: int = 2, water: bool = True) -> DataFrame:
    """Change of an index from before `split` to after it, with flags of affected and severe cells.

    Cells need min_obs clear observations in both windows, and are dropped as water if MNDWI says so on both dates
    (`kept` tells). Both windows come from one scan and one shuffle.
    """
    late = F.col("day") >= F.lit(split).cast("date")
    sides = [F.median(F.when(late if after else ~late, F.col(b))).alias(f"{b}_{k}") for k, after in enumerate((False, True)) for b in OPTICAL]
    seen = F.coalesce(*(F.col(b) for b in OPTICAL)).isNotNull()
    counts = [F.count(F.when(seen & (late if k else ~late), 1)).alias(f"n_{k}") for k in (0, 1)]
    cells = obs.groupBy(*CELL).agg(*sides, *counts)

    def of(name: str, k: int) -> Column:
        return index(name, Bands(*(f"{b}_{k}" for b in OPTICAL)))

    wet = (of("MNDWI", 0) >= 0) & (of("MNDWI", 1) >= 0)
    kept = (F.col("n_0") >= min_obs) & (F.col("n_1") >= min_obs)
    if water:
        kept = kept & ~F.coalesce(wet, F.lit(False))
    direction, affected, severe, _ = METHODS[method]
    delta = F.when(kept, of(method, 1) - of(method, 0))
    past = (lambda bound: F.col("delta") < bound) if direction == "loss" else (lambda bound: F.col("delta") > bound)
    return cells.select(*CELL, "n_0", "n_1", kept.alias("kept"), delta.alias("delta")).withColumns({"affected": past(affected), "severe": past(severe)})


def change_summary(cells: DataFrame) -> DataFrame:
    """One row: mean change, percent of valid cells that are affected or severe, percent of cells dropped."""
    pct = lambda x: (100 * F.avg(F.col(x).cast("int"))).alias(f"pct_{x}")
    return cells.agg(F.count("delta").alias("n_valid"), F.avg("delta").alias("mean_delta"), pct("affected"), pct("severe"), (100 * F.avg((~F.col("kept")).cast("int"))).alias("pct_dropped"))


def epochs(obs: DataFrame, value: Column, epoch: Column, n: int, how=F.median) -> DataFrame:
    """One row for each cell with columns e0, e1, ...: the value's median in each of n epochs."""
    marked = obs.withColumn("_value", value).withColumn("_epoch", epoch)
    return marked.groupBy(*CELL).agg(*(how(F.when(F.col("_epoch") == k, F.col("_value"))).alias(f"e{k}") for k in range(n)))


def first_loss(cells: DataFrame, n: int, baseline: float, drop: float) -> DataFrame:
    """Epoch at which a cell first fell by more than `drop` below its baseline e0; only cells above `baseline` count."""
    hit = F.lit(None).cast("int")
    for k in reversed(range(1, n)):
        hit = F.when(F.col("e0") - F.col(f"e{k}") > drop, k).otherwise(hit)
    return cells.withColumn("was_forest", F.col("e0") > baseline).withColumn("loss_epoch", F.when(F.col("was_forest"), hit))


def first_over(cells: DataFrame, n: int, bound: float) -> Column:
    """First epoch above a bound."""
    hit = F.lit(None).cast("int")
    for k in reversed(range(n)):
        hit = F.when(F.col(f"e{k}") > bound, k).otherwise(hit)
    return hit


def window_z(values: DataFrame, keys: Sequence[str], year: Column, value: str, current: int) -> DataFrame:
    """Standard score of the current year's mean against the means of the other years (population deviation), by keys."""
    years = values.groupBy(*keys, year.alias("_year")).agg(F.avg(value).alias("_mean"))
    base = F.when(F.col("_year") != current, F.col("_mean"))
    out = years.groupBy(*keys).agg(F.max(F.when(F.col("_year") == current, F.col("_mean"))).alias("now"), F.avg(base).alias("mean"), F.stddev_pop(base).alias("sd"), F.count(base).alias("n_years"))
    return out.withColumn("z", F.try_divide(F.col("now") - F.col("mean"), F.col("sd")))


def condition_index(values: DataFrame, keys: Sequence[str], now: Column, value: str, inverted: bool = False) -> DataFrame:
    """Position of the current mean between the baseline's least and most, 0 to 100."""
    out = values.groupBy(*keys).agg(F.avg(F.when(now, F.col(value))).alias("now"), F.min(F.when(~now, F.col(value))).alias("least"), F.max(F.when(~now, F.col(value))).alias("most"))
    place = F.try_divide(F.col("now") - F.col("least"), F.col("most") - F.col("least")) * 100
    place = 100 - place if inverted else place
    return out.withColumn("condition", F.when(place.isNotNull(), F.least(F.greatest(place, F.lit(0.0)), F.lit(100.0))))


def orbit_choice(scenes: DataFrame, orbit: str, windows: Sequence[Column]) -> DataFrame:
    """The orbit with scenes in all windows, else with most scenes; the first by name among equals."""
    counts = [F.sum(F.coalesce(w, F.lit(False)).cast("long")).alias(f"n_{k}") for k, w in enumerate(windows)]
    found = scenes.groupBy(orbit).agg(*counts)
    whole, total = F.lit(True), F.lit(0)
    for k in range(len(windows)):
        whole, total = whole & (F.col(f"n_{k}") > 0), total + F.col(f"n_{k}")
    return found.withColumns({"covers_all": whole, "n_scenes": total}).orderBy(F.desc("covers_all"), F.desc("n_scenes"), orbit).limit(1)


def latest_common_pair(scenes: DataFrame, track: str, event: str) -> DataFrame:
    """Last scene before the event and first after it, on the track whose scene after it is the most recent."""
    day, date = F.col("day"), F.lit(event).cast("date")
    pairs = scenes.groupBy(track).agg(F.max(F.when(day < date, F.struct("day", "scene_id"))).alias("pre"), F.min(F.when(day >= date, F.struct("day", "scene_id"))).alias("post"))
    both = pairs.where("pre IS NOT NULL AND post IS NOT NULL")
    flat = both.select(track, F.col("pre.day").alias("pre_day"), F.col("pre.scene_id").alias("pre_scene"), F.col("post.day").alias("post_day"), F.col("post.scene_id").alias("post_scene"))
    return flat.orderBy(F.desc("post_day"), track).limit(1)
