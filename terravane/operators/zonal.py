"""Zones: spatial joins, sampling on grids, and aggregates by zone and class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import in_polygon

EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"


def rectangles(zones: DataFrame, w: str = "w", s: str = "s", e: str = "e", n: str = "n") -> DataFrame:
    """zones with their outlines as edges array<struct<x1,y1,x2,y2>>, the form all polygons take."""
    w, s, e, n = (F.col(x) for x in (w, s, e, n))
    ring = [(w, s, e, s), (e, s, e, n), (e, n, w, n), (w, n, w, s)]
    edge = lambda q: F.struct(*(x.alias(k) for x, k in zip(q, ("x1", "y1", "x2", "y2"))))
    return zones.withColumn("edges", F.array(*map(edge, ring)))


def within(points: DataFrame, zones: DataFrame, x: str, y: str, key: Sequence[str], ordinal: str, tile: float = 1.0, keep_outside: bool = True) -> DataFrame:
    """Each point with the columns of the zone it lies in, the first by `ordinal` where zones overlap.

    Zones are dealt out over the square tiles that their boxes touch, so the join is an equi-join on tiles, whose hot
    tiles Spark can split; the even-odd test runs on what meets there. key: columns that identify a point.
    """
    low = lambda k: F.array_min(F.transform("edges", lambda e: F.least(e[k + "1"], e[k + "2"])))
    high = lambda k: F.array_max(F.transform("edges", lambda e: F.greatest(e[k + "1"], e[k + "2"])))
    cell = lambda v: F.floor(v / tile)
    tiles = lambda k: F.sequence(cell(low(k)), cell(high(k)))
    spread = zones.withColumn("_tx", F.explode(tiles("x"))).withColumn("_ty", F.explode(tiles("y")))
    placed = points.withColumns({"_tx": cell(F.col(x)), "_ty": cell(F.col(y))})
    met = placed.join(spread, ["_tx", "_ty"], "inner").where(in_polygon(F.col(x), F.col(y), F.col("edges"))).drop("_tx", "_ty", "edges")
    one = met.groupBy(*key).agg(F.min_by(F.struct(*(c for c in zones.columns if c != "edges")), ordinal).alias("_zone"))
    out = points.join(one, list(key), "left" if keep_outside else "inner")
    return out.select(*points.columns, *(F.col(f"_zone.{c}").alias(c) for c in zones.columns if c != "edges"))


def zone_codes(zones: DataFrame, name: str, missing: str = "(none)") -> DataFrame:
    """Codes 1, 2, ... of the zones' names in their order; a null or blank name is named `missing`. 0 is left for outside.

    Distinct names are few beside zones, so their one window is over names.
    """
    label = F.when(F.trim(name) == "", missing).otherwise(F.coalesce(name, F.lit(missing)))
    names = zones.select(label.alias("_name")).distinct()
    codes = names.withColumn("code", F.row_number().over(Window.orderBy("_name")))
    return zones.withColumn("_name", label).join(F.broadcast(codes), "_name").drop("_name")


def grid_index(value: Column, origin: float, step: float, n: int) -> Column:
    """Row or column of the cell that holds a coordinate, clipped to the grid."""
    return F.when(value.isNotNull(), F.least(F.greatest(F.floor((value - origin) / step), F.lit(0)), F.lit(n - 1))).cast("int")


def rescaled_index(i: Column, n_from: int, n_to: int) -> Column:
    """Index on a grid of n_from cells that nearest sampling gives for index i on one of n_to."""
    return F.floor(i * n_from / n_to).cast("int")


def class_areas(cells: DataFrame, code: str, area: Column, classes: Sequence[int]) -> DataFrame:
    """Area of each class, 0 for classes without cells, and its percentage of all classes."""
    labels = cells.sparkSession.createDataFrame([(k,) for k in classes], f"{code} int")
    found = cells.groupBy(code).agg(F.sum(area).alias("area"))
    out = labels.join(found, code, "left").select(code, F.coalesce("area", F.lit(0.0)).alias("area"))
    return out.withColumn("pct", 100 * F.try_divide(F.col("area"), F.sum("area").over(Window.partitionBy(F.lit(0)))))


def cross_tab(cells: DataFrame, zone: str, code: str, area: Column, classes: Sequence[int]) -> DataFrame:
    """Area by zone and class, with a column for cells without a class. Cells outside all zones are left out."""
    inside = cells.where(F.col(zone).isNotNull())
    sums = [F.sum(F.when(F.col(code) == k, area).otherwise(0.0)).alias(f"class_{k}") for k in classes]
    none = F.sum(F.when(F.col(code).isNull(), area).otherwise(0.0)).alias("no_data")
    return inside.groupBy(zone).agg(*sums, none, F.sum(area).alias("total"))


def person_days(daily: DataFrame, zone: str, day: str, pm: str, population: str, bounds: Sequence[float]) -> DataFrame:
    """By zone: person-days in each class of air quality, and the worst day with its value."""
    from ..functions.classes import class_up_to

    graded = daily.withColumn("_class", class_up_to(F.col(pm), bounds))
    sums = [F.sum(F.when(F.col("_class") == k, F.col(population)).otherwise(0)).alias(f"person_days_{k}") for k in range(len(bounds) + 1)]
    return graded.groupBy(zone).agg(*sums, F.max(pm).alias("worst"), F.max_by(day, F.struct(pm, F.negate(F.unix_date(day)))).alias("worst_day"))


def material_zones(zones: DataFrame, area: str, share: float = 0.01) -> DataFrame:
    """Zones with at least `share` of the whole area; slivers are left out."""
    total = zones.agg(F.sum(area).alias("_total"))
    return zones.crossJoin(F.broadcast(total)).where(F.col(area) >= share * F.col("_total")).drop("_total")
