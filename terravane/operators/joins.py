"""Nearest, as-of, rank and neighbour joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder, written


def root_of_squares(x: Column, y: Column) -> Column:
    """Length of (x, y). Squares and roots are rounded alike by all engines, hypot is not; so where lengths decide (ties, steps along a line), this is used."""
    return F.sqrt(x * x + y * y)


def nearest(
    points: DataFrame, targets: DataFrame, key: Sequence[str], x: str, y: str, tx: str, ty: str, target: str, cap: float, scale: tuple[Column | float, Column | float] = (1.0, 1.0), digits: int | None = None, crowd: int = 64
) -> DataFrame:
    """Each point with its nearest target within `cap` (planar units) and the distance, NULL beyond it.

    `scale` turns differences in x and y into the cap's units; `digits` rounds distances before they are compared. Equal
    distances go to the least target.

    Different places alone are looked at, on either side: repeated points get the target of their place, of targets at one place the least stands
    for all. Places are dealt out over squares, targets to the nine around theirs, so no pair farther apart than a square's
    side need meet. Where a square of the cap's size holds over `crowd` targets, finer squares come first, a quarter of the next
    one's side, and only places that find none within that side go on. `key` names a point's own columns; repeated points may share them.
    """
    at = [F.col(k) for k in ("_x", "_y")]
    zero = lambda v: F.col(v) + 0.0  # noqa: E731  (-0.0 is 0.0)
    placed = points.withColumns({"_x": zero(x), "_y": zero(y)})
    sites = targets.select(F.col(target), zero(tx).alias("_tx"), zero(ty).alias("_ty")).dropna(subset=["_tx", "_ty"]).groupBy("_tx", "_ty").agg(F.min(target).alias(target))
    # a little wider than the cap, so that rounding never puts places that far apart two squares apart
    square = lambda v, k, side: F.floor(v * scale[k] / (side * (1 + 1e-9)))
    most = sites.groupBy(square(F.col("_tx"), 0, cap), square(F.col("_ty"), 1, cap)).count().agg(F.max("count")).first()[0] or 0
    steps = 0
    while most > crowd and steps < 12:
        most, steps = most / 16, steps + 1
    left, found = placed.select("_x", "_y").dropna().distinct(), None
    if steps:
        left, sites = written(left, shared_folder(points.sparkSession)), written(sites, shared_folder(points.sparkSession))
    for step in range(steps, -1, -1):
        side = cap / 4**step
        near = sites
        for k, (name, column) in enumerate((("_sx", "_tx"), ("_sy", "_ty"))):
            own = square(F.col(column), k, side)
            near = near.withColumn(name, F.explode(F.sequence(own - 1, own + 1)))
        met = left.withColumns({"_sx": square(at[0], 0, side), "_sy": square(at[1], 1, side)}).join(near, ["_sx", "_sy"])
        exact = root_of_squares((at[0] - F.col("_tx")) * scale[0], (at[1] - F.col("_ty")) * scale[1])
        # a finer step takes no target at its very edge, so that none beyond it is as near after rounding
        met = met.withColumn("_exact", exact).where(F.col("_exact") <= (side * (1 - 1e-6) if step else side))
        best = met.groupBy("_x", "_y").agg(F.min(F.struct((F.col("_exact") if digits is None else F.round("_exact", digits)).alias("distance"), target)).alias("_best"))
        if step:
            best = written(best, shared_folder(points.sparkSession))
            left = written(left.join(best, ["_x", "_y"], "left_anti"), shared_folder(points.sparkSession))
        found = best if found is None else found.unionByName(best)
    return placed.join(found, ["_x", "_y"], "left").select(*points.columns, F.col(f"_best.{target}").alias(target), F.col("_best.distance").alias("distance"))


def around(event: Column, day: str, value: str) -> list[Column]:
    """Aggregates: the last value at or before an event and the first one after it."""
    d = F.col(day)
    return [F.max(F.when(d <= event, F.struct(day, value))).alias("before"), F.min(F.when(d > event, F.struct(day, value))).alias("after")]


def rank_pairs(scenes: DataFrame, by: Sequence[str], day: str, scene: str, most_apart: int, most_days: int) -> DataFrame:
    """Pairs of scenes of one track that are at most `most_apart` places and `most_days` days apart. Only leads
    within a window are looked at; no pair is built to be thrown away."""
    order = Window.partitionBy(*by).orderBy(day, scene)
    leads = F.array(*(F.struct(F.lead(scene, k).over(order).alias("scene_2"), F.lead(day, k).over(order).alias("day_2")) for k in range(1, most_apart + 1)))
    pairs = scenes.select(*by, F.col(scene).alias("scene_1"), F.col(day).alias("day_1"), leads.alias("_next"))
    flat = pairs.select(*by, "scene_1", "day_1", F.explode("_next").alias("_n")).select(*by, "scene_1", "day_1", "_n.scene_2", "_n.day_2")
    return flat.where(F.col("scene_2").isNotNull() & (F.datediff("day_2", "day_1") <= most_days))


def nearest_epoch(epochs: DataFrame, epoch: str, year: int) -> DataFrame:
    """The row whose epoch is nearest to a year; the earlier one among equals."""
    return epochs.orderBy(F.abs(F.col(epoch) - year), epoch).limit(1)


ROOK = ((-1, 0), (1, 0), (0, -1), (0, 1))
QUEEN = ROOK + ((-1, -1), (-1, 1), (1, -1), (1, 1))


def neighbours(cells: DataFrame, value: str, offsets: Sequence[tuple[int, int]] = ROOK) -> DataFrame:
    """(r, c, value, other): each cell with each neighbour that exists."""
    steps = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets))
    sent = cells.select("r", "c", F.col(value).alias("other"), F.explode(steps).alias("_d"))
    sent = sent.select((F.col("r") + F.col("_d.dr")).alias("r"), (F.col("c") + F.col("_d.dc")).alias("c"), "other")
    return cells.select("r", "c", value).join(sent, ["r", "c"])
