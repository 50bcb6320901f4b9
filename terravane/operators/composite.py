"""From observations over time to one value for each cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("r", "c")


def composite(obs: DataFrame, bands: Sequence[str], how: str = "median", cell: Sequence[str] = CELL) -> DataFrame:
    """One row for each cell, with the reduced bands and n_obs, the count of observations that any band has.

    how: median (exact), mean, max, min or sum; NULLs are left out.
    """
    reduce = {"median": F.median, "mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[how]
    return obs.groupBy(*cell).agg(*(reduce(b).alias(b) for b in bands), F.count(F.coalesce(*(F.col(b) for b in bands))).alias("n_obs"))


def period_composite(obs: DataFrame, value: str, period: Column, periods: Sequence[str], cell: Sequence[str] = CELL) -> DataFrame:
    """Means of several periods side by side, one column each; what was averaged is power, so decibels come later."""
    return obs.withColumn("_period", period).groupBy(*cell).pivot("_period", list(periods)).agg(F.avg(value))


def solar_days(obs: DataFrame, bands: Sequence[str], day: str = "day", cell: Sequence[str] = CELL) -> DataFrame:
    """Observations of one day as one, by their mean."""
    return obs.groupBy(*cell, day).agg(*(F.avg(b).alias(b) for b in bands))


def block_sum(cells: DataFrame, value: str, factor: int, rows: int, columns: int) -> DataFrame:
    """Sums over blocks of factor by factor cells; a ragged edge is dropped, as sums over part of a block would mislead."""
    whole = (F.col("r") < rows // factor * factor) & (F.col("c") < columns // factor * factor)
    block = lambda x: F.floor(F.col(x) / factor).cast("int").alias(x)
    return cells.where(whole).groupBy(block("r"), block("c")).agg(F.sum(value).alias(value))


def yearly_recurrence(obs: DataFrame, happened: Column, day: str = "day", cell: Sequence[str] = CELL) -> DataFrame:
    """Years in which a cell was hit at least once."""
    years = obs.groupBy(*cell, F.year(day).alias("_year")).agg(F.max(F.coalesce(happened, F.lit(False)).cast("int")).alias("_hit"))
    return years.groupBy(*cell).agg(F.sum("_hit").alias("years_hit"))


def daily(values: DataFrame, day: str, value: str, start: str, end: str, how: str = "mean") -> DataFrame:
    """A value for each day of [start, end): a day without data has a NULL mean, but a sum or count of 0."""
    calendar = values.sparkSession.sql(f"SELECT explode(sequence(date'{start}', date_sub(date'{end}', 1))) AS day")
    reduce = {"mean": F.avg, "sum": F.sum, "count": F.count, "max": F.max}[how]
    found = values.groupBy(F.col(day).alias("day")).agg(reduce(value).alias("value"))
    filled = F.coalesce("value", F.lit(0)) if how in ("sum", "count") else F.col("value")
    return calendar.join(found, "day", "left").select("day", filled.alias("value"))


def widened(obs: DataFrame, year: int, pads: Sequence[int] = (0, 1, 2), day: str = "day") -> DataFrame:
    """Observations of the narrowest window year - pad ... year + pad that has any."""
    away = F.abs(F.year(day) - year)
    wide = F.lit(None).cast("int")
    for p in reversed(pads):
        wide = F.when(away <= p, p).otherwise(wide)
    marked = obs.withColumn("_pad", wide).where("_pad IS NOT NULL")
    least = marked.agg(F.min("_pad").alias("_least"))  # one row
    return marked.join(F.broadcast(least), F.col("_pad") <= F.col("_least")).drop("_pad", "_least")
