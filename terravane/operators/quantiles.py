"""Exact quantiles and ranks of whole columns, from histograms and windows within their bins, so that no task sees all values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of about equally many distinct values: two to this power.
STEPS = 10


def levels(values: DataFrame, value: str, **sums: Column) -> DataFrame:
    """One row for each distinct value: its sums, and for each sum `_before_<name>`, that of all smaller values.

    Values are dealt out over 2**STEPS bins between approximate quantiles of the distinct values, so that no bin is crowded however the values
    lie; windows are over the bins, and over the distinct values of one bin.
    """
    v = values.where(F.col(value).isNotNull()).groupBy(value).agg(*(c.alias(k) for k, c in sums.items()))
    bins = 1 << STEPS
    ends = v.agg(F.percentile_approx(value, [k / bins for k in range(1, bins)], 4 * bins).alias("_e"))  # one row
    binned = v.crossJoin(F.broadcast(ends)).withColumn("_bin", F.lit(0))
    for k in reversed(range(STEPS)):  # the bin is the number of edges that the value reaches, found by halving
        binned = binned.withColumn("_bin", F.col("_bin") + F.when(F.get("_e", F.col("_bin") + ((1 << k) - 1)) <= F.col(value), 1 << k).otherwise(0))
    binned = binned.drop("_e")
    totals = binned.groupBy(F.col("_bin").alias("_at")).agg(*(F.sum(k).alias(f"_all_{k}") for k in sums))
    earlier = Window.orderBy("_at")  # over as many rows as there are bins
    totals = totals.select("_at", *((F.sum(f"_all_{k}").over(earlier) - F.col(f"_all_{k}")).alias(f"_bins_{k}") for k in sums))
    own = Window.partitionBy("_bin").orderBy(value)
    inner = binned.select("*", *((F.sum(k).over(own) - F.col(k)).alias(f"_own_{k}") for k in sums))
    met = inner.join(F.broadcast(totals), F.col("_bin") == F.col("_at"))
    return met.select(value, *sums, *((F.col(f"_bins_{k}") + F.col(f"_own_{k}")).alias(f"_before_{k}") for k in sums))


def quantiles(values: DataFrame, value: str, wanted: Mapping[str, float]) -> DataFrame:
    """One row with the wanted quantiles, interpolated between neighbours as exact percentiles are, and `n`, the number of values."""
    ranked = levels(values, value, _n=F.count("*"))
    size = ranked.agg(F.sum("_n").alias("n"))  # one row
    both = ranked.crossJoin(F.broadcast(size))
    at = {k: (F.col("n") - 1) * q for k, q in wanted.items()}
    holds = lambda place: (F.col("_before__n") <= place) & (place < F.col("_before__n") + F.col("_n"))
    low = {k: F.max(F.when(holds(F.floor(p)), F.col(value))).alias(f"_low_{k}") for k, p in at.items()}
    high = {k: F.max(F.when(holds(F.ceil(p)), F.col(value))).alias(f"_high_{k}") for k, p in at.items()}
    found = both.agg(F.max("n").alias("n"), *low.values(), *high.values())
    part = {k: p - F.floor(p) for k, p in at.items()}
    return found.select(*((F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * part[k]).alias(k) for k in wanted), "n")
