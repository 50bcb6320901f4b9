"""Assessments of one's own tables: thresholds, dates and column names are parameters, and the defaults are the published ones.

Cells are identified by `keys`. Periods are given as conditions or dates; a value without a counterpart in the other period is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import ISPU, class_up_to
from ..functions.indices import decibels
from ..functions.masks import clamp
from .graph import despeckled
from .joins import QUEEN
from .quantiles import quantiles

CELL = ("r", "c")


def since(day: str, split: str) -> Column:
    return F.col(day) >= F.lit(split).cast("date")


def count_if(rule: Column) -> Column:
    return F.count(F.when(rule, 1))


def pct_if(rule: Column) -> Column:
    return 100 * F.avg(rule.cast("int"))


def backscatter(obs: DataFrame, power: str, after: Column, keys: Sequence[str] = CELL) -> DataFrame:
    """(keys, pre, post): dB of the mean power of two periods; power that isn't positive is no measurement."""
    p = F.when(F.col(power) > 0, F.col(power))
    return obs.groupBy(*keys).agg(decibels(F.avg(F.when(~after, p))).alias("pre"), decibels(F.avg(F.when(after, p))).alias("post"))


def flood(obs: DataFrame, split: str, power: str = "vv", day: str = "day", threshold: float = -16.0, least: int = 8, land: DataFrame | None = None) -> DataFrame:
    """(r, c) of cells under the threshold after `split` and not before it, in regions of `least` cells or more; land: cells (r, c) to keep to."""
    wet = backscatter(obs, power, since(day, split)).where((F.col("post") < threshold) & ~(F.col("pre") < threshold))
    if land is not None:
        wet = wet.join(land.select("r", "c").distinct(), ["r", "c"], "left_semi")
    return despeckled(wet, least, QUEEN).select("r", "c")


def disturbance(obs: DataFrame, slopes: DataFrame, after: Column, power: str = "vh", affected: float = -3.0, severe: float = -6.0, steep: float = 15.0) -> DataFrame:
    """(r, c, change, grade, steep): change of backscatter in dB, graded 1 and 2 by how far it fell; steep cells are like landslides, the others like sediment.
    slopes: (r, c, slope) in degrees."""
    b = backscatter(obs, power, after).select("r", "c", (F.col("post") - F.col("pre")).alias("change"))
    grade = F.when(F.col("change") < severe, 2).when(F.col("change") < affected, 1).otherwise(0)
    return b.join(slopes, ["r", "c"]).select("r", "c", "change", grade.alias("grade"), (F.col("slope") > steep).alias("steep"))


def urban_growth(obs: DataFrame, before: Column, after: Column, green: str, built: str, keys: Sequence[str] = CELL, green_first: float = 0.3, green_last: float = 0.2, fall: float = -0.15, over: float = 0.2, km2: float = 0.0009) -> DataFrame:
    """One row: cells that lost their vegetation (green before, not after, by a clear fall), newly built ones, and built km2 in each period."""
    u = obs.groupBy(*keys).agg(*(F.avg(F.when(side, F.col(i))).alias(n) for side, i, n in ((before, green, "v0"), (after, green, "v1"), (before, built, "b0"), (after, built, "b1"))))
    v0, v1, b0, b1 = (F.col(x) for x in ("v0", "v1", "b0", "b1"))
    lost = (v0 > green_first) & (v1 < green_last) & (v1 - v0 < fall)
    return u.agg(count_if(lost).alias("lost"), count_if((b1 > over) & ~(b0 > over)).alias("new_urban"), (count_if(b0 > over) * km2).alias("km2_first"), (count_if(b1 > over) * km2).alias("km2_last"))


def rain_by_year(rain: DataFrame, year: Column, value: str, decimals: int = 2) -> DataFrame:
    """(y, total, z, pct, driest): sums of each year's rows with their standard score, percent of normal and rank of the driest; equal when rounded
    is equal. Windows are over one row a year."""
    y = rain.groupBy(year.cast("long").alias("y")).agg(F.sum(value).alias("total"))
    every = Window.partitionBy(F.lit(0))
    mean = F.avg("total").over(every)
    z = F.try_divide(F.col("total") - mean, F.stddev_pop("total").over(every))
    return y.select("y", "total", z.alias("z"), (100 * F.try_divide(F.col("total"), mean)).alias("pct"), F.rank().over(Window.orderBy(F.round("total", decimals))).cast("long").alias("driest"))


def percent_of_normal(rain: DataFrame, keys: Sequence[str], year: Column, value: str, now: int) -> DataFrame:
    """(keys, pct): a year's sum in each cell as a percentage of the mean of the years before."""
    y = rain.groupBy(*keys, year.alias("_y")).agg(F.sum(value).alias("_sum"))
    current, base = F.max(F.when(F.col("_y") == now, F.col("_sum"))), F.avg(F.when(F.col("_y") < now, F.col("_sum")))
    return y.groupBy(*keys).agg((100 * F.try_divide(current, base)).alias("pct"))


def box_anomaly(field: DataFrame, box: Column, day: str, value: str) -> DataFrame:
    """(y, m, anomaly): monthly means of a box against the climatology of each month."""
    v = field.where(box).groupBy(F.year(day).cast("long").alias("y"), F.month(day).cast("long").alias("m")).agg(F.avg(value).alias("_v"))
    return v.select("y", "m", (F.col("_v") - F.avg("_v").over(Window.partitionBy("m"))).alias("anomaly"))


def dipole(field: DataFrame, west: Column, east: Column, day: str, value: str) -> DataFrame:
    """(day, dipole): how far a western box is from its own mean, less the same of an eastern one; windows over one row a day."""
    m = field.groupBy(day).agg(F.avg(F.when(west, F.col(value))).alias("_w"), F.avg(F.when(east, F.col(value))).alias("_e"))
    away = lambda x: F.col(x) - F.avg(x).over(Window.partitionBy(F.lit(0)))
    return m.select(day, (away("_w") - away("_e")).alias("dipole"))


def heat_island(cells: DataFrame, urban: Column, temperature: str, height: str | None = None, within: float = 50.0, rural: Column | None = None) -> DataFrame:
    """One row (urban, rural, suhii, n_rural): mean temperatures of urban and rural cells and their difference. With a height, rural cells are those
    within some metres of the city's mean height."""
    rest = ~urban if rural is None else rural
    if height is not None:
        city = cells.where(urban).agg(F.avg(height).alias("_city"))  # one row
        cells = cells.crossJoin(F.broadcast(city))
        rest = rest & (F.abs(F.col(height) - F.col("_city")) <= within)
    u, r = F.avg(F.when(urban, F.col(temperature))), F.avg(F.when(rest, F.col(temperature)))
    return cells.agg(u.alias("urban"), r.alias("rural"), (u - r).alias("suhii"), count_if(rest).alias("n_rural"))


def coherence_drop(pairs: DataFrame, keys: Sequence[str], after: Column, coherence: str, usable: float = 0.30, drop: float = 0.30, cell_ha: float = 1.0) -> DataFrame:
    """One row: cells whose coherence before is usable, those of them where it fell by `drop`, their area and share, and the 5th and 95th percentile of the
    fall over all cells."""
    a = pairs.groupBy(*keys).agg(F.avg(F.when(~after, F.col(coherence))).alias("_pre"), F.avg(F.when(after, F.col(coherence))).alias("_post")).withColumn("_fall", F.col("_pre") - F.col("_post"))
    good = F.col("_pre") >= usable
    fell = F.when(good, (F.col("_fall") >= drop).cast("int"))
    sums = a.agg(count_if(good).alias("usable"), count_if(fell == 1).alias("fell"), (count_if(fell == 1) * cell_ha).alias("ha"), (100 * F.avg(fell)).alias("pct"))
    return sums.crossJoin(quantiles(a, "_fall", {"p05": 0.05, "p95": 0.95}).drop("n"))  # one row each


def greenness(obs: DataFrame, before: Column, after: Column, index: Column, keys: Sequence[str] = CELL, **means: str) -> DataFrame:
    """(keys, a, b, ...): mean of an index in two periods, and means of other columns over all rows."""
    return obs.groupBy(*keys).agg(F.avg(F.when(before, index)).alias("a"), F.avg(F.when(after, index)).alias("b"), *(F.avg(c).alias(n) for n, c in means.items()))


def close_up(cells: DataFrame, shown: str, keys: Sequence[str] = CELL, green: float = 0.3, fall: float = -0.2, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(keys, lost, shown): cells of `greenness` that were green and fell, and a column stretched between two of its quantiles. A masked value stays masked."""
    e = quantiles(cells, shown, {"_lo": low, "_hi": high}).drop("n")  # one row
    lost = (F.col("a") > green) & (F.col("b") - F.col("a") < fall)
    return cells.crossJoin(F.broadcast(e)).select(*keys, lost.alias("lost"), clamp(F.try_divide(F.col(shown) - F.col("_lo"), F.col("_hi") - F.col("_lo")), 0.0, 1.0).alias("shown"))


def regraded(cells: DataFrame, light: str, low: float = 0.55, high: float = 0.999, gamma: float = 2.0, gain: float = 0.9) -> DataFrame:
    """cells with `lift`: how far a shaded cell is raised from the dark colour, from 0 at one quantile of the light to `gain` at another, by a power. Masked light
    stays masked."""
    e = quantiles(cells, light, {"_lo": low, "_hi": high}).drop("n")  # one row
    t = clamp((F.col(light) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6), 0.0, 1.0)
    return cells.crossJoin(F.broadcast(e)).withColumn("lift", F.pow(t, F.lit(gamma)) * gain).drop("_lo", "_hi")


def greenness_change(cells: DataFrame, affected: float = -0.05, severe: float = -0.15) -> DataFrame:
    """One row: means of `greenness` before and after, their change, and percent of cells that fell by the two bounds."""
    x = F.col("b") - F.col("a")
    return cells.agg(F.avg("a").alias("before"), F.avg("b").alias("after"), F.avg(x).alias("change"), pct_if(x < affected).alias("pct_affected"), pct_if(x < severe).alias("pct_severe"))


def nearest_centroids(rows: DataFrame, key: str, features: str, label: str, train: Column) -> DataFrame:
    """(key, label, guess) of the rows that aren't for training: the label whose mean vector of the training rows is nearest, the least of equal ones. Centroids are as
    few as labels."""
    long = rows.select(key, F.col(label).alias("label"), train.alias("_train"), F.posexplode(features).alias("_i", "_v")).withColumn("_v", F.col("_v").cast("double"))
    c = long.where("_train").groupBy(F.col("label").alias("_k"), "_i").agg(F.avg("_v").alias("_m"))
    far = long.where("NOT _train").join(c, "_i").groupBy(key, "label", "_k").agg(F.sum(F.pow(F.col("_v") - F.col("_m"), F.lit(2.0))).alias("_d"))
    return far.groupBy(key, "label").agg(F.min_by("_k", F.struct(F.round("_d", 9), "_k")).alias("guess"))


def area_reducers(cells: DataFrame, value: str, mask: str | None = None, quantile: float = 0.9) -> DataFrame:
    """One row: number of cells and of valid ones, mean, sum, least, most, standard deviation and a quantile of a value, and the percentage of valid cells in a mask."""
    v = cells.select(F.col(value).cast("double").alias("_v"), (F.col(mask).cast("int") if mask else F.lit(None).cast("int")).alias("_m"))
    valid = F.col("_v").isNotNull()
    sums = v.agg(F.count("*").alias("n"), F.count("_v").alias("valid"), F.avg("_v").alias("mean"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.stddev_pop("_v").alias("sd"), (100 * F.avg(F.when(valid, F.col("_m")))).alias("pct_mask"))
    return sums.crossJoin(quantiles(v, "_v", {"quantile": quantile}).drop("n"))  # one row each


def year_to_date(rows: DataFrame, day: str, first: str, last: str, now: int, recent: int, value: str | None = None) -> DataFrame:
    """(y, n, against_mean, against_recent, rank): counts (or sums) of the same part of each year, `first` up to but without `last` (MM-dd), against the means
    of the years before `now` and of those from `recent` on."""
    at = F.date_format(day, "MM-dd")
    y = rows.where((at >= first) & (at < last)).groupBy(F.year(day).cast("long").alias("y")).agg((F.count("*") if value is None else F.sum(value)).alias("n"))
    before = F.when(F.col("y") < now, F.col("n"))
    b = y.agg(F.avg(before).alias("_mean"), F.avg(F.when(F.col("y") >= recent, before)).alias("_recent"))  # one row
    return y.crossJoin(F.broadcast(b)).select("y", "n", F.try_divide("n", "_mean").alias("against_mean"), F.try_divide("n", "_recent").alias("against_recent"), F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("rank"))


def share_of_total(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, total, pct): sums and their percentage of all; the window is over the groups."""
    s = rows.groupBy(*by).agg(F.sum(value).alias("total"))
    return s.withColumn("pct", 100 * F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy(F.lit(0)))))


def building_grid(buildings: DataFrame, x: Column, y: Column, area: str, size: float = 400.0, confidence: str | None = None, least: float = 0.70) -> DataFrame:
    """(gx, gy, n, area): buildings of a confidence and their area by square cells."""
    kept = buildings if confidence is None else buildings.where(F.col(confidence) >= least)
    return kept.groupBy(F.floor(x / size).alias("gx"), F.floor(y / size).alias("gy")).agg(F.count("*").alias("n"), F.sum(area).alias("area"))


def haze_run(daily: DataFrame, day: str, value: str, classes: Sequence[float] = ISPU, who: float = 15.0) -> DataFrame:
    """One row: days, mean, most, the worst and the latest day, days by class, and days above a guideline."""
    pm = daily.withColumn("_k", class_up_to(F.col(value), classes))
    own = [count_if(F.col("_k") == k).alias(f"class_{k}") for k in range(len(classes) + 1)]
    latest = F.max_by(value, day)
    return pm.agg(F.count("*").alias("days"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.max_by(day, F.struct(value, day)).alias("worst_day"), latest.isNotNull().alias("has_latest"), latest.alias("latest"), *own, count_if(F.col(value) > who).alias("above_who"))


def newest(scenes: DataFrame, by: Sequence[str], day: str, today: str, stale: int = 21) -> DataFrame:
    """(by, newest, default_end, stale): the newest day, the one before it as a default end, and whether it is more than some days old."""
    n = F.max(day)
    return scenes.groupBy(*by).agg(n.alias("newest"), F.date_sub(n, 1).alias("default_end"), (F.datediff(F.lit(today).cast("date"), n) > stale).alias("stale"))


def imagery_state(obs: DataFrame, start: str, end: str, clear: Column, day: str = "day", keys: Sequence[str] = CELL) -> DataFrame:
    """(state, cells, pct): cells of a composite without data told apart: no scene passed, or all that did were cloudy."""
    passed = since(day, start) & ~since(day, end)
    seen = obs.where(passed).groupBy(*keys).agg(count_if(clear).alias("_clear"), F.count("*").alias("_passes"))
    state = F.when(F.col("_passes").isNull(), "no pass").when(F.col("_clear") == 0, "all cloudy").otherwise("clear")
    n = obs.select(*keys).distinct().join(seen, list(keys), "left").groupBy(state.alias("state")).agg(F.count("*").alias("cells"))
    return n.select("state", "cells", (100 * F.col("cells") / F.sum("cells").over(Window.partitionBy(F.lit(0)))).alias("pct"))


def claims(zones: DataFrame, name: str, area: str, classes: Sequence[str], crossings: Mapping[str, DataFrame] | None = None, share: float = 0.01) -> DataFrame:
    """(zone, claim): sentences that the numbers bear out. zones: name, area in ha and the percentage of each class, driest last. Zones under `share` of
    the whole area are left out; the zone with most of the last class leads; crossings: by code, (name, crossed, censored)."""
    whole = zones.agg(F.sum(area).alias("_whole"))  # one row
    kept = zones.crossJoin(F.broadcast(whole)).where(F.col(area) >= share * F.col("_whole"))
    worst = F.col(classes[-1])
    first = F.row_number().over(Window.orderBy(F.desc(worst), name))
    said = F.format_string("%s: %.1f %% of %,d ha in class " + classes[-1] + "%s", F.col(name), worst, F.col(area).cast("long"), F.when(first == 1, ", the most of all zones").otherwise(""))
    out = kept.where(worst.isNotNull()).select(F.col(name).alias("zone"), said.alias("claim"))
    for code, crossed in (crossings or {}).items():
        at = crossed.join(kept.select(name), name)
        text = F.when(F.col("censored"), F.format_string("%s: %s stood over its threshold on the first day of the record already", F.col(name), F.lit(code)))
        text = text.when(F.col("crossed").isNotNull(), F.format_string("%s: %s crossed its threshold on %s", F.col(name), F.lit(code), F.col("crossed").cast("string")))
        out = out.union(at.select(F.col(name), text.otherwise(F.format_string("%s: %s never crossed its threshold", F.col(name), F.lit(code)))))
    return out
