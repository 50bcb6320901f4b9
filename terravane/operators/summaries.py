"""Summaries of one's own tables for reports, maps and the next run: column names, bounds and sizes are parameters. Nothing is rounded here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def display_frame(points: DataFrame, x: str, y: str, area: tuple[float, float, float, float], low: float = 0.02, high: float = 0.98, pad: float = 0.1, shape: float = 1.5) -> DataFrame:
    """One row (w, s, e, n): the box of the points between two quantiles and of an area (w, s, e, n), padded, its shorter side grown to a shape, within the globe. One
    runaway point doesn't set the frame."""
    c = F.col
    q = quantiles(points, x, {"w": low, "e": high}).drop("n").crossJoin(quantiles(points, y, {"s": low, "_top": high}).drop("n"))  # one row each
    bounds = {k: F.lit(float(v)) for k, v in zip(("w", "s", "e", "n"), area)}
    b = q.select(F.least("w", bounds["w"]).alias("w"), F.greatest("e", bounds["e"]).alias("e"), F.least("s", bounds["s"]).alias("s"), F.greatest("_top", bounds["n"]).alias("n"))
    dx, dy = c("e") - c("w"), c("n") - c("s")
    b = b.select((c("w") - dx * pad).alias("w"), (c("e") + dx * pad).alias("e"), (c("s") - dy * pad).alias("s"), (c("n") + dy * pad).alias("n"))
    gx, gy = F.greatest(dy * shape - dx, F.lit(0.0)) / 2, F.greatest(dx / shape - dy, F.lit(0.0)) / 2
    return b.select(F.greatest(c("w") - gx, F.lit(-180.0)).alias("w"), F.greatest(c("s") - gy, F.lit(-90.0)).alias("s"), F.least(c("e") + gx, F.lit(180.0)).alias("e"), F.least(c("n") + gy, F.lit(90.0)).alias("n"))


def captions(names: DataFrame, by: str, name: str, order: str, budget: int = 125) -> DataFrame:
    """(by, caption, n): names joined by commas as long as whole ones fit into a caption's budget of characters."""
    until = F.sum(F.length(name) + 2).over(Window.partitionBy(by).orderBy(order)) - 2
    fits = names.withColumn("_until", until).where(F.col("_until") <= budget)
    joined = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))), lambda x: x["n"]))
    return fits.groupBy(by).agg(joined.alias("caption"), F.count("*").alias("n"))


def priced(jobs: DataFrame, by: str, prices: Mapping[str, int], otherwise: int) -> DataFrame:
    """(by, cost): prices by name from a short table, a constant for those it lacks."""
    known = F.create_map(*(F.lit(x) for pair in prices.items() for x in pair)) if prices else None
    price = F.lit(otherwise) if known is None else F.coalesce(F.get(F.array(F.try_element_at(known, F.col(by))), F.lit(0)), F.lit(otherwise))
    return jobs.groupBy(by).agg(F.count("*").alias("_n")).select(by, (price * F.col("_n")).alias("cost"))


def auto_cell_km(w: Column, s: Column, e: Column, n: Column, cells: int = 380, least: float = 1.0, most: float = 25.0) -> Column:
    """The size of cells at which a box is some cells wide, within bounds."""
    width = (e - w) * 111.32 * F.cos(F.radians((s + n) / 2))
    return F.when(width.isNotNull(), F.least(F.greatest(width / cells, F.lit(least)), F.lit(most)))


def bands_by_count(bands: Column) -> tuple[Column, Column]:
    """Red and near infrared of a list of bands: sensors with eight have them elsewhere than those with four."""
    eight = F.size(bands) >= 8
    return F.element_at(bands, F.when(eight, 6).otherwise(3)), F.element_at(bands, F.when(eight, 8).otherwise(4))


def cumulative_months(rows: DataFrame, day: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, m, n, so_far): counts by month and their running sum within the year."""
    n = rows.groupBy(*by, F.year(day).cast("long").alias("y"), F.month(day).cast("long").alias("m")).agg(F.count("*").alias("n"))
    return n.withColumn("so_far", F.sum("n").over(Window.partitionBy(*by, "y").orderBy("m")))


def best_and_worst(rows: DataFrame, key: str, gain: str, k: int = 3) -> DataFrame:
    """(side, key, gain): the k rows that gained most and least, as two top-k's; equal ones in order of the key."""
    known = rows.where(F.col(gain).isNotNull())
    top = lambda order, name: known.orderBy(order, key).limit(k).select(F.lit(name).alias("side"), key, gain)
    return top(F.desc(gain), "best").union(top(F.asc(gain), "worst"))


def by_fractions(totals: DataFrame, groups: DataFrame, by: str, total: str, kind: str, kinds: Mapping[str, object]) -> DataFrame:
    """(by, ...): a year's totals shared out by the fractions that the rows of another one have of some kinds; kinds: column to value."""
    part = lambda v: F.sum(F.when(F.col(kind) == v, 1).otherwise(0)) / F.greatest(F.count("*"), F.lit(1e-6))
    shares = groups.groupBy(by).agg(*(part(v).alias(n) for n, v in kinds.items()))
    return shares.join(totals.select(by, F.col(total).alias("_total")), by).select(by, *((F.col(n) * F.col("_total")).alias(n) for n in kinds))


def annual_heat(rows: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """(y, mean, hottest): the mean of cells' monthly means in each year, and the highest value of any month."""
    m = rows.groupBy(*keys, F.year(day).cast("long").alias("y"), F.month(day).alias("_m")).agg(F.avg(value).alias("_t"), F.max(value).alias("_hot"))
    return m.groupBy("y").agg(F.avg("_t").alias("mean"), F.max("_hot").alias("hottest"))


def daily_stack(rows: DataFrame, key: str, day: str, value: str, days: Sequence[str]) -> DataFrame:
    """(key, day_1, day_2, ...): one column for each of some days, for output; everything else stays long."""
    return rows.groupBy(key).agg(*(F.max(F.when(F.col(day) == F.lit(d).cast("date"), F.col(value))).alias(f"day_{k}") for k, d in enumerate(days, 1)))


def decayed_frames(events: DataFrame, ts: str, every: str = "6 hours", frames: int = 2) -> DataFrame:
    """(frame, n, weight): at the end of each step, the events of the last few steps, the latest weighing most: weights fall to 0 over the whole reach."""
    w = F.window(ts, every)
    e = events.select(F.col(ts).alias("_ts"), w.start.cast("timestamp").alias("_s"), (F.unix_timestamp(w.end) - F.unix_timestamp(w.start)).alias("_step"))
    e = e.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(frames))))
    f = e.select("_ts", "_step", F.timestamp_seconds(F.unix_timestamp("_s") + F.col("_k") * F.col("_step")).alias("frame")).withColumn("_age", F.unix_timestamp("frame") - F.unix_timestamp("_ts")).where(F.col("_ts") > F.timestamp_seconds(F.unix_timestamp("frame") - frames * F.col("_step")))
    return f.groupBy("frame").agg(F.count("*").alias("n"), F.sum(1 - F.col("_age") / (frames * F.col("_step"))).alias("weight"))


def equal_bins(rows: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """(bin, n, low, high): classes of equal count by their edges, exact quantiles."""
    edges = quantiles(rows, value, {f"_e{q}": q / bins for q in range(1, bins)}).drop("n")  # one row
    own = sum(((F.col(value) > F.col(f"_e{q}")).cast("int") for q in range(1, bins)), F.lit(0))
    return rows.crossJoin(F.broadcast(edges)).groupBy(own.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def newest_files(files: DataFrame, day: str) -> DataFrame:
    """The files of the newest day, with `covered`: the last day of its month, up to which an archive by months is covered."""
    last = files.agg(F.max(day).alias("_newest"))  # one row
    return files.join(F.broadcast(last), F.col(day) == F.col("_newest")).withColumn("covered", F.last_day("_newest")).drop("_newest")


def best_window(days: DataFrame, day: str, epochs: int = 20) -> DataFrame:
    """One row (first, last, covered): of all runs of consecutive epochs the one with most of them, the earliest of equal ones; the window is over one row a day."""
    w = Window.orderBy(day).rowsBetween(0, epochs - 1)
    own = days.select(day).distinct()
    return own.select(F.col(day).alias("first"), F.max(day).over(w).alias("last"), F.count("*").over(w).alias("covered")).orderBy(F.desc("covered"), "first").limit(1)


def sign_check(cells: DataFrame, a: str, b: str) -> DataFrame:
    """One row (slope, r, same_sign): whether two fields follow one sign convention, by the line through them."""
    return cells.agg(F.regr_slope(b, a).alias("slope"), F.corr(a, b).alias("r"), (F.regr_slope(b, a) > 0).alias("same_sign"))


def patch_cm(cells: DataFrame, box: Column, phase: str, wavelength_cm: float = 5.6) -> DataFrame:
    """(r, c, cm): a patch of phase without its median, as centimetres along the line of sight."""
    p = cells.where(box)
    m = p.agg(F.median(phase).alias("_m"))  # one row
    return p.crossJoin(F.broadcast(m)).select("r", "c", ((F.col(phase) - F.col("_m")) * (wavelength_cm / (4 * F.pi()))).alias("cm"))


def last_days(rows: DataFrame, day: str, n: int = 7) -> DataFrame:
    """The rows of the last n days, counted from the newest one there is."""
    last = rows.agg(F.max(day).alias("_newest"))  # one row
    return rows.join(F.broadcast(last), F.col(day) >= F.date_sub("_newest", n - 1)).drop("_newest")


def record_years(rows: DataFrame, day: str, first: int) -> DataFrame:
    """(y): the years of a record from `first` on, clamped to what the archive holds."""
    ends = rows.agg(F.year(F.min(day)).alias("_a"), F.year(F.max(day)).alias("_b"))
    return ends.select(F.explode(F.sequence(F.greatest(F.lit(first), "_a").cast("long"), F.col("_b").cast("long"))).alias("y"))


def strongest(rows: DataFrame, by: Sequence[str], value: str, key: str, k: int = 5) -> DataFrame:
    """The k strongest rows of each group, the least key first among equal ones: where forward runs start."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), key)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def worst_days(daily: DataFrame, key: str, day: str, value: str, k: int = 3) -> DataFrame:
    """(key, value, day) of the k places with the worst day, where backward runs start."""
    b = daily.groupBy(key).agg(F.max(value).alias(value), F.max_by(day, F.struct(value, day)).alias(day))
    return b.orderBy(F.desc(value), key).limit(k)


def hour_completeness(rows: DataFrame, ts: str, hours: int = 24) -> DataFrame:
    """(day, n, hours, complete): rows and different hours of each day, and whether none is missing."""
    e = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count_distinct(F.hour(ts)).alias("hours"), F.count("*").alias("n"))
    return e.select("day", "n", "hours", (F.col("hours") == hours).alias("complete"))


def burn_rates(burned: DataFrame, peat: DataFrame, year: str, hit: str) -> DataFrame:
    """(year, burned, on_peat, peat_rate, other_rate): cells burned in each year and percent of peat and of other cells; peat: cells (r, c) of a raster that may cover
    only a part, cells beyond it aren't peat."""
    b = burned.join(peat.select("r", "c").distinct().withColumn("_peat", F.lit(True)), ["r", "c"], "left").withColumn("_peat", F.coalesce("_peat", F.lit(False)))
    rate = lambda on: 100 * F.avg(F.when(on, F.col(hit)))
    return b.groupBy(year).agg(F.count(F.when(F.col(hit) == 1, 1)).alias("burned"), F.count(F.when((F.col(hit) == 1) & F.col("_peat"), 1)).alias("on_peat"), rate(F.col("_peat")).alias("peat_rate"), rate(~F.col("_peat")).alias("other_rate"))
