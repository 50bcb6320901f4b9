"""Stacks of radar pairs: which scenes serve, what their files hold, how far their values can be trusted."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def usable_scenes(scenes: DataFrame, usable: Column) -> DataFrame:
    """Scenes that aren't marked as unusable, the newest first; a missing mark is no reason to drop one."""
    return scenes.where(F.coalesce(usable, F.lit(True))).orderBy(F.desc("day"), "scene_id")


def stats_lines(lines: DataFrame, text: str, least: int = 5) -> DataFrame:
    """Lines of numbers (first, second, and the rest) with `least` fields or more; comments and shorter lines are dropped."""
    fields = F.split(F.trim(text), r"\s+")
    kept = lines.where(~F.trim(text).startswith("#")).withColumn("_f", fields).where(F.size("_f") >= least)
    return kept.withColumns({"first": F.col("_f")[0], "second": F.col("_f")[1], "value": F.col("_f")[least - 1].try_cast("double")}).drop("_f")


def trusted_range(cells: DataFrame, value: str, coherence: str, least: float = 0.3) -> DataFrame:
    """One row: cells, trusted cells, and least, most, 5th and 95th percentile of the value over trusted cells."""
    known = cells.select(F.when(F.col(coherence) >= least, F.col(value)).alias("_v"))
    sums = known.agg(F.count("*").alias("cells"), F.count("_v").alias("trusted"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    return sums.crossJoin(quantiles(known, "_v", {"p05": 0.05, "p95": 0.95}).drop("n"))  # one row each


def exceedance(cells: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Percent of known cells at or above each bound, from one pass."""
    sums = cells.agg(F.count(value).alias("_n"), *(F.count(F.when(F.col(value) >= b, 1)).alias(f"_k{i}") for i, b in enumerate(bounds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("bound"), F.col(f"_k{i}").alias("cells")) for i, b in enumerate(bounds))))
    return sums.select("_n", rows.alias("_row")).select("_row.bound", "_row.cells", (100 * F.try_divide("_row.cells", "_n")).alias("pct"))


def mask_polarity(cells: DataFrame, value: str, mask: Column) -> DataFrame:
    """One row: the value's mean inside and outside a mask, and whether the mask marks what is to be kept (the higher mean)."""
    inside, outside = F.avg(F.when(mask, F.col(value))), F.avg(F.when(~mask, F.col(value)))
    return cells.agg(inside.alias("inside"), outside.alias("outside"), (inside > outside).alias("keeps"))


def file_state(files: DataFrame, product: str, name: str, size: str, needed: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """By product: missing parts, damaged (empty) ones, whether it is complete, and the bytes that pruning to the suffixes `keep` would free."""
    has = lambda suffix: F.max(F.when(F.endswith(F.col(name), F.lit(suffix)), F.col(size)))
    kept = F.lit(False)
    for suffix in keep:
        kept = kept | F.endswith(F.col(name), F.lit(suffix))
    found = files.groupBy(product).agg(*(has(s).alias(f"_s{k}") for k, s in enumerate(needed)), F.sum(F.when(kept, 0).otherwise(F.col(size))).alias("prunable"), F.sum(size).alias("bytes"))
    missing = sum((F.col(f"_s{k}").isNull().cast("int") for k in range(len(needed))), F.lit(0))
    damaged = sum((F.coalesce(F.col(f"_s{k}") == 0, F.lit(False)).cast("int") for k in range(len(needed))), F.lit(0))
    state = F.when(damaged > 0, "damaged").when(missing > 0, "pending").otherwise("complete")
    return found.select(product, missing.alias("missing"), damaged.alias("damaged"), state.alias("state"), "prunable", "bytes")


def without_band(products: DataFrame, files: DataFrame, product: str, name: str, suffix: str) -> DataFrame:
    """Products of which no file has a suffix."""
    having = files.where(F.endswith(F.col(name), F.lit(suffix))).select(product).distinct()
    return products.select(product).distinct().join(having, product, "left_anti")


def picks(scenes: DataFrame, track: Sequence[str], event: Column, before: int = 2, after: int = 1) -> DataFrame:
    """The last `before` scenes at or before an event and the first `after` ones after it, by track, numbered from the event outwards."""
    late = F.col("day") > event
    out = scenes.withColumns({"side": F.when(late, "after").otherwise("before"), "_away": F.abs(F.datediff("day", event))})
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*track, "side").orderBy("_away", "scene_id")))
    return out.where(F.col("place") <= F.when(late, after).otherwise(before)).drop("_away")


#: A prime that isn't one more than a multiple of 3, so that cubes modulo it are all different.
DRAWS = 1_000_037


def poisson_bounds(most: int = 8) -> list[int]:
    """Numbers below DRAWS from which on a draw counts once, twice, ... by a Poisson law of mean 1."""
    bounds, level, term = [], 0.0, 2.718281828459045**-1
    for k in range(most):
        level += term
        bounds.append(round(level * DRAWS))
        term /= k + 1
    return bounds


def bootstrap(values: DataFrame, block: str, angle: str, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, direction, length) of circular means over blocks drawn again with replacement. Each block, an integer, counts a number of times
    that a cube modulo a prime of it and the replicate gives, distributed as Poisson(1), so every replicate is a sum, whatever the order of rows."""
    blocks = values.groupBy(block).agg(F.avg(F.sin(angle)).alias("_s"), F.avg(F.cos(angle)).alias("_c"))
    drawn = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    x = F.pmod(F.col(block).cast("long") * 7919 + F.col("replicate") * 104729 + 31 * seed, F.lit(DRAWS))
    u = x * x % DRAWS * x % DRAWS
    times = sum(((u >= b).cast("int") for b in poisson_bounds()), F.lit(0))
    drawn = drawn.withColumn("_n", times)
    sums = drawn.groupBy("replicate").agg(F.sum(F.col("_n") * F.col("_s")).alias("_s"), F.sum(F.col("_n") * F.col("_c")).alias("_c"), F.sum("_n").alias("_n"))
    return sums.select("replicate", F.atan2("_s", "_c").alias("direction"), F.try_divide(F.hypot("_s", "_c"), "_n").alias("length"))


def elevation_fit(cells: DataFrame, height: str, value: str, bins: int) -> DataFrame:
    """One row: R squared of a line of value on height, and of medians in `bins` classes of equal count."""
    known = cells.where(F.col(height).isNotNull() & F.col(value).isNotNull()).select(F.col(height).alias("h"), F.col(value).alias("v"))
    edges = quantiles(known, "h", {f"e{k}": (k + 1) / bins for k in range(bins - 1)}).drop("n")
    own = sum(((F.col("h") > F.col(f"e{k}")).cast("int") for k in range(bins - 1)), F.lit(0))
    binned = known.crossJoin(F.broadcast(edges)).withColumn("bin", own)  # one row of edges
    medians = binned.groupBy("bin").agg(F.median("v").alias("m"))
    fitted = binned.join(F.broadcast(medians), "bin")
    total = F.var_pop("v")
    return fitted.agg(F.regr_r2("v", "h").alias("line_r2"), (1 - F.try_divide(F.avg((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))), total)).alias("bins_r2"), F.count("*").alias("n"))


def reference_spread(cells: DataFrame, references: Sequence[tuple[float, float]], reach: float, value: str, at: tuple[float, float]) -> DataFrame:
    """By reference place: the median value around it and the value around a target with that median taken off. One pass, since references are few."""
    near = lambda r, c: F.hypot(F.col("r") - r, F.col("c") - c) <= reach
    here = F.median(F.when(near(*at), F.col(value)))
    sums = cells.agg(here.alias("_here"), *(F.median(F.when(near(*p), F.col(value))).alias(f"_m{k}") for k, p in enumerate(references)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("reference"), F.col(f"_m{k}").alias("median")) for k in range(len(references)))))
    # a place without cells around it is no reference
    out = sums.select("_here", rows.alias("_row")).select("_row.reference", "_row.median", (F.col("_here") - F.col("_row.median")).alias("against"))
    return out.where("median IS NOT NULL")


def local_resultant(cells: DataFrame, angle: str, sizes: Sequence[int]) -> DataFrame:
    """(size, blocks, length): mean length of the resultant of angles over blocks of several sizes, of those more than half full."""
    out = None
    for n in sizes:
        block = lambda k: F.floor(F.col(k) / n)  # noqa: B023, E731
        m = cells.groupBy(block("r").alias("br"), block("c").alias("bc")).agg(F.hypot(F.avg(F.sin(angle)), F.avg(F.cos(angle))).alias("_len"), F.count(angle).alias("_n"))
        part = m.where(F.col("_n") * 2 > n * n).agg(F.lit(n).alias("size"), F.count("*").alias("blocks"), F.avg("_len").alias("length"))
        out = part if out is None else out.union(part)
    return out


def scenes_needed(sigma: Column, before: Column, bound: float, most: int) -> Column:
    """The least number of scenes after an event, up to `most`, for which two standard errors of a step, sigma * sqrt(1/before + 1/n), come within a bound;
    NULL if even `most` are too few."""
    return F.array_min(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: 2 * sigma * F.sqrt(1 / before + 1 / n) <= bound))


def swept(rows: DataFrame, lists: Mapping[str, Iterable[int]]) -> DataFrame:
    """Every row with each combination of a few parameter values, by generators within the row: no join, and no more rows at once than a batch makes."""
    for name, values in lists.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows
