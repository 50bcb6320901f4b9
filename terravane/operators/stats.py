"""Statistics of cells and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import neighbours
from .quantiles import levels, quantiles


def slope_through_origin(pairs: DataFrame, keys: Sequence[str], x: str, y: str, least: int) -> DataFrame:
    """Least-squares slope without intercept by keys, NULL under `least` pairs: two sums, whatever the number of pairs."""
    out = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.sum(F.col(x) * F.col(y)).alias("_xy"), F.sum(F.col(x) * F.col(x)).alias("_xx"), F.count("*").alias("n"))
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.try_divide(F.col("_xy"), F.col("_xx"))).alias("slope"))


def plane(cells: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: z = a + b x + c y by least squares, from nine sums and Cramer's rule, and R squared."""
    v = {"1": F.lit(1.0), "x": F.col(x), "y": F.col(y), "z": F.col(z)}
    pairs = ("11", "1x", "1y", "1z", "xx", "xy", "xz", "yy", "yz", "zz")
    s = cells.where(F.col(z).isNotNull()).agg(*(F.sum(v[a] * v[b]).alias(f"s{a}{b}") for a, b in pairs))
    g = {f"{a}{b}": F.col(f"s{a}{b}") for a, b in pairs}
    rows = [("11", "1x", "1y"), ("1x", "xx", "xy"), ("1y", "xy", "yy")]
    right = ("1z", "xz", "yz")

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    whole = det([[g[k] for k in row] for row in rows])
    solved = [F.try_divide(det([[g[right[i]] if j == k else g[name] for j, name in enumerate(row)] for i, row in enumerate(rows)]), whole).alias(name) for k, name in enumerate("abc")]
    s = s.select("*", *solved)
    explained = F.col("a") * g["1z"] + F.col("b") * g["xz"] + F.col("c") * g["yz"] - g["1z"] * g["1z"] / g["11"]
    return s.select("a", "b", "c", F.try_divide(explained, g["zz"] - g["1z"] * g["1z"] / g["11"]).alias("r2"))


def median_and_mad(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and scaled median absolute deviation by keys."""
    middle = values.groupBy(*keys).agg(F.median(value).alias("median"))
    away = values.join(middle, list(keys)).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    return away.groupBy(*keys).agg(F.first("median").alias("median"), (F.median("_away") * 1.4826).alias("mad"))


def binned(values: DataFrame, x: Column, width: float, y: str, least: int, low: float = 0.1) -> DataFrame:
    """Median, a low percentile and the count of y in bins of x; bins with fewer than `least` values are left out."""
    bins = values.groupBy((F.floor(x / width) * width).alias("bin"))
    return bins.agg(F.median(y).alias("median"), F.percentile(y, low).alias("low"), F.count(y).alias("n")).where(F.col("n") >= least)


def circular(values: DataFrame, keys: Sequence[str], angle: str, least: float = 0.0) -> DataFrame:
    """Mean direction and resultant length of angles by keys; the direction is NULL if the length is below `least`."""
    m = values.groupBy(*keys).agg(F.avg(F.sin(angle)).alias("_s"), F.avg(F.cos(angle)).alias("_c"), F.count(angle).alias("n"))
    m = m.withColumn("length", F.hypot("_s", "_c"))
    return m.select(*keys, F.when(F.col("length") >= least, F.atan2("_s", "_c")).alias("direction"), "length", "n")


def morans_i(cells: DataFrame, value: str) -> DataFrame:
    """One row: Moran's I with rook neighbours of equal weight, and their number."""
    known = cells.where(F.col(value).isNotNull()).select("r", "c", value)
    mean = known.agg(F.avg(value).alias("_m"))
    away = known.crossJoin(F.broadcast(mean)).select("r", "c", (F.col(value) - F.col("_m")).alias("d"))
    cross = neighbours(away, "d").agg(F.sum(F.col("d") * F.col("other")).alias("_num"), F.count("*").alias("n_pairs"))
    spread = away.agg(F.sum(F.col("d") * F.col("d")).alias("_den"), F.count("*").alias("n"))
    return cross.crossJoin(F.broadcast(spread)).select("n", "n_pairs", F.try_divide(F.col("n") * F.col("_num"), F.col("n_pairs") * F.col("_den")).alias("i"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson's r, root mean square and 95th percentile of the difference."""
    d = F.col(a) - F.col(b)
    sums = pairs.agg(F.corr(a, b).alias("r"), F.sqrt(F.avg(d * d)).alias("rms"))
    return sums.crossJoin(quantiles(pairs.select(F.abs(d).alias("_away")), "_away", {"p95": 0.95}).select("p95"))  # one row each


def auc(values: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve: from counts for each distinct score, equal scores counting half; ranks come from bins of scores."""
    ranked = levels(values, score, p=F.sum(positive.cast("long")), n=F.sum((~positive).cast("long")))
    won = ranked.select("p", "n", (F.col("p") * (F.col("_before_n") + F.col("n") / 2)).alias("_won"))
    return won.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.try_divide(F.sum("_won"), F.sum("p") * F.sum("n")).alias("auc"))


def confusion_metrics(confusion: DataFrame, label: str, prediction: str, n: str) -> DataFrame:
    """By class: producer's and consumer's accuracy, and beside them the overall accuracy and kappa. confusion: one row for each label and
    prediction that occur."""
    hit = F.sum(F.when(F.col(label) == F.col(prediction), F.col(n)).otherwise(0))
    rows = confusion.groupBy(F.col(label).alias("class")).agg(F.sum(n).alias("_row"), hit.alias("_hit"))
    columns = confusion.groupBy(F.col(prediction).alias("class")).agg(F.sum(n).alias("_column"))
    both = rows.join(columns, "class", "full").select("class", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("_row", "_column", "_hit")))
    whole = both.agg(F.sum("_row").alias("_n"), F.sum("_hit").alias("_right"), F.sum(F.col("_row").cast("double") * F.col("_column")).alias("_chance"))  # one row
    chance, right = F.col("_chance") / (F.col("_n") * F.col("_n")), F.col("_right") / F.col("_n")
    out = both.crossJoin(F.broadcast(whole))
    return out.select("class", F.try_divide("_hit", "_row").alias("producer"), F.try_divide("_hit", "_column").alias("consumer"), right.alias("accuracy"), F.try_divide(right - chance, 1 - chance).alias("kappa"))


def trend(series: DataFrame, keys: Sequence[str], year: str, value: str, least: int = 3) -> DataFrame:
    """Linear trend for each decade, and the change from the first to the last year, by keys; NULL under `least` years."""
    known = series.where(F.col(value).isNotNull())
    out = known.groupBy(*keys).agg(F.regr_slope(value, year).alias("_s"), F.min_by(value, year).alias("_first"), F.max_by(value, year).alias("_last"), F.count("*").alias("n"))
    enough = F.col("n") >= least
    return out.select(*keys, "n", F.when(enough, F.col("_s") * 10).alias("per_decade"), F.when(enough, F.col("_last") - F.col("_first")).alias("change"))


def otsu(values: DataFrame, value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """One row: the threshold that separates two classes best, from a histogram of `bins` rows."""
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1))
    hist = values.where(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    order = Window.orderBy("bin")
    middle = low + (F.col("bin") + 0.5) * width
    run = hist.select("bin", F.sum("n").over(order).alias("w0"), F.sum(F.col("n") * middle).over(order).alias("s0"))
    whole = hist.agg(F.sum("n").alias("w"), F.sum(F.col("n") * middle).alias("s"))
    both = run.crossJoin(F.broadcast(whole)).where("w0 < w")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    scored = both.withColumn("between", F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap)
    return scored.orderBy(F.desc(F.round("between", 6)), "bin").limit(1).select((low + (F.col("bin") + 1) * width).alias("threshold"))


def trailing_run(series: DataFrame, keys: Sequence[str], day: str, holds: Column) -> DataFrame:
    """Length and first day of the run of days for which a condition holds up to the last day, by keys."""
    last_break = F.max(F.when(~F.coalesce(holds, F.lit(False)), F.col(day)))
    ends = series.groupBy(*keys).agg(last_break.alias("_break"))
    after = series.join(ends, list(keys)).where(F.col("_break").isNull() | (F.col(day) > F.col("_break")))
    return after.groupBy(*keys).agg(F.count("*").alias("run_days"), F.min(day).alias("since"))


def runs(series: DataFrame, keys: Sequence[str], order: str, holds: Column) -> DataFrame:
    """All runs of consecutive rows for which a condition holds: number, first and last, by keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = series.withColumn("_holds", F.coalesce(holds, F.lit(False))).withColumn("_run", F.sum((~F.col("_holds")).cast("int")).over(w))
    return marked.where("_holds").groupBy(*keys, "_run").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last")).drop("_run")
