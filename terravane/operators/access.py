"""Who is served: people and streets by their distance to stops along a network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_KM


def served_shares(homes: DataFrame, near: DataFrame, people: str, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: people whose node is within it, all people, and the share. near: (node, dist) of the nodes reached;
    people at nodes that nothing reaches count among all."""
    met = homes.join(near, "node", "left")
    sums = met.agg(F.sum(people).alias("people"), *(F.sum(F.when(F.col("dist") <= t, F.col(people)).otherwise(0)).alias(f"_s{k}") for k, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_s{k}").alias("served")) for k, t in enumerate(thresholds))))
    return sums.select("people", rows.alias("_row")).select("_row.threshold", "_row.served", "people", (100 * F.try_divide("_row.served", "people")).alias("pct"))


def served_edges(edges: DataFrame, near: DataFrame, reach: float) -> DataFrame:
    """edges (src, dst, ...) with `served`: whether both of their ends are within reach."""
    inside = near.where(F.col("dist") <= reach).select("node", F.lit(True).alias("_in"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(inside.select(F.col("node").alias(end), F.col("_in").alias(f"_{end}")), end, "left")
    return out.withColumn("served", F.coalesce("_src", F.lit(False)) & F.coalesce("_dst", F.lit(False))).drop("_src", "_dst")


def auto_box(points: DataFrame, x: str, y: str, km: float, scale: str = "local") -> DataFrame:
    """One row (w, s, e, n): the box of points with `km` around it."""
    east, north = DEGREE_KM[scale]
    b = points.agg(F.min(x).alias("w"), F.max(x).alias("e"), F.min(y).alias("s"), F.max(y).alias("n"))
    dx = F.lit(km) / (east * F.cos(F.radians((F.col("s") + F.col("n")) / 2)))
    return b.select((F.col("w") - dx).alias("w"), (F.col("s") - km / north).alias("s"), (F.col("e") + dx).alias("e"), (F.col("n") + km / north).alias("n"))
