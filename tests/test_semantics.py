"""Rules that each guard against a wrong number: nulls, inclusive bounds, tie-breaks, conservation."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions.classes import SPI, class_from_above, class_up_to, drought_class
from terravane.functions.fire import bui, danger_class, dc_next, dmc_next, ffmc_next, fwi, isi
from terravane.functions.geo import in_polygon
from terravane.functions.masks import clamp, is_named, no_nan, where_chain
from terravane.operators.folds import first_crossing, parcels
from terravane.operators.graph import despeckled, distances
from terravane.operators.grid import unwrapped
from terravane.operators.joins import ROOK, nearest
from terravane.operators.paths import contour, crossed
from terravane.operators.stats import slope_through_origin
from terravane.operators.zonal import cross_tab, rectangles, within


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_nulls_stay_null(spark):
    x = F.lit(None).cast("double")
    got = one(spark, clamped=clamp(x, 0, 1), nan=no_nan(F.lit(float("nan"))), inf=no_nan(F.lit(float("inf"))), number=no_nan(F.lit(2.0)))
    assert got == {"clamped": None, "nan": None, "inf": None, "number": 2.0}


def test_last_rule_wins(spark):
    x = F.lit(5)
    assert one(spark, v=where_chain(F.lit(0), (x > 1, 1), (x > 2, 2), (x > 9, 3)))["v"] == 2


@pytest.mark.parametrize(("name", "named"), [(None, False), ("  ", False), ("?", False), ("Administrative unit not available", False), ("Kota Unnamed", False), ("Kapuas", True), ("None Lake", True)])
def test_names(spark, name, named):
    assert one(spark, v=is_named(F.lit(name).cast("string")))["v"] is named


def test_bounds_are_inclusive_where_they_should_be(spark):
    got = one(spark, low=danger_class("FFMC", F.lit(73.0)), spi=class_from_above(F.lit(-1.0), SPI), ispu=class_up_to(F.lit(15.5), (15.5, 55.4)), above=class_up_to(F.lit(60.0), (15.5, 55.4)), none=danger_class("DC", F.lit(None).cast("double")))
    assert got == {"low": 1, "spi": 3, "ispu": 0, "above": 2, "none": None}


def test_drought_classes(spark):
    cases = {(-2.0, 0.0, 80.0): 1, (-2.0, -2.0, 80.0): 2, (-2.0, -2.0, 20.0): 3, (0.0, -2.0, 80.0): 4, (0.0, 0.0, 20.0): 4, (0.0, 0.0, 80.0): 0}
    for (a, b, c), want in cases.items():
        assert one(spark, v=drought_class(F.lit(a), F.lit(b), F.lit(c)))["v"] == want


def test_published_fire_weather_case(spark):
    """The published first test day: 17 degrees, 42 %, 25 km/h, no rain, in April."""
    x = lambda v: F.lit(float(v))
    got = one(spark, ffmc=ffmc_next(x(85), x(17), x(42), x(25), x(0)), dmc=dmc_next(x(6), x(17), x(42), x(0), x(12.8)), dc=dc_next(x(15), x(17), x(0), x(0.9)))
    assert math.isclose(got["ffmc"], 87.69, abs_tol=0.01)
    assert math.isclose(got["dmc"], 8.55, abs_tol=0.01)
    assert math.isclose(got["dc"], 19.01, abs_tol=0.01)
    spread = isi(x(got["ffmc"]), x(25))
    rest = one(spark, isi=spread, bui=bui(x(got["dmc"]), x(got["dc"])), fwi=fwi(spread, bui(x(got["dmc"]), x(got["dc"]))))
    assert math.isclose(rest["isi"], 10.85, abs_tol=0.02)
    assert math.isclose(rest["bui"], 8.5, abs_tol=0.05)
    assert math.isclose(rest["fwi"], 10.1, abs_tol=0.1)


def test_even_odd_rule_has_holes(spark):
    def ring(w, s, e, n):
        return [(w, s, e, s), (e, s, e, n), (e, n, w, n), (w, n, w, s)]

    edges = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), q))) for q in ring(0, 0, 10, 10) + ring(4, 4, 6, 6)))
    inside = [in_polygon(F.lit(x), F.lit(y), edges) for x, y in ((1.0, 1.0), (5.0, 5.0), (11.0, 5.0), (5.0, 4.0))]
    assert list(one(spark, **{f"p{k}": c for k, c in enumerate(inside)}).values()) == [True, False, False, False]


def test_overlapping_zones_give_one_row_a_point(spark):
    zones = rectangles(spark.createDataFrame([(2, 0.0, 0.0, 5.0, 5.0), (1, 3.0, 3.0, 9.0, 9.0)], "z int, w double, s double, e double, n double"))
    points = spark.createDataFrame([(1, 4.0, 4.0), (2, 1.0, 1.0), (3, 20.0, 1.0)], "id int, x double, y double")
    assert {r.id: r.z for r in within(points, zones, "x", "y", ["id"], "z").collect()} == {1: 1, 2: 2, 3: None}


def test_cross_tab_conserves_area(spark):
    rows = [("a", 0, 1.0), ("a", None, 2.0), ("b", 1, 4.0), (None, 1, 8.0)]
    t = cross_tab(spark.createDataFrame(rows, "z string, k int, ha double"), "z", "k", F.col("ha"), [0, 1]).collect()
    assert sum(r.total for r in t) == 7.0 and all(math.isclose(r.total, r.class_0 + r.class_1 + r.no_data) for r in t)


def test_nearest_respects_the_cap(spark):
    rng = np.random.default_rng(0)
    p, q = rng.random((60, 2)) * 10, rng.random((25, 2)) * 10
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id int, x double, y double")
    stops = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(q)], "stop int, sx double, sy double")
    got = {r.id: r.distance for r in nearest(points, stops, ["id"], "x", "y", "sx", "sy", "stop", 1.0).collect()}
    away = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)).min(1)
    assert all((got[k] is None and d > 1) or math.isclose(got[k], d) for k, d in enumerate(away))


def test_regions_keep_long_snakes(spark):
    snake = [(0, c) for c in range(40)] + [(1, 39)] + [(2, c) for c in range(40)] + [(9, 9)]
    kept = despeckled(spark.createDataFrame(snake, "r int, c int"), 2, ROOK).collect()
    assert len(kept) == 81 and len({r.label for r in kept}) == 1


def test_distances_take_the_shorter_way(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 9.0), (2, 2, 1.0)], "src long, dst long, len double")
    got = {r.node: r.dist for r in distances(edges, spark.createDataFrame([(1,)], "node long"), 6.0).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 2.0}


def test_crossing_on_the_first_day_is_censored(spark):
    rows = [("a", 1, 90.0), ("a", 2, 95.0), ("b", 1, 10.0), ("b", 2, 61.0), ("c", 1, 5.0)]
    got = {r.k: (r.crossed, r.censored) for r in first_crossing(spark.createDataFrame(rows, "k string, day int, v double"), ["k"], "day", "v", 60).collect()}
    assert got == {"a": (1, True), "b": (2, False), "c": (None, None)}


def test_unwrapping_undoes_wrapping(spark):
    ramp = np.arange(50) * 1.3
    rows = [(1, k, float((v + np.pi) % (2 * np.pi) - np.pi)) for k, v in enumerate(ramp)]
    got = [r.unwrapped for r in unwrapped(spark.createDataFrame(rows, "k int, i int, phase double"), ["k"], "i", "phase").orderBy("i").collect()]
    assert np.allclose(np.array(got) - got[0], ramp - ramp[0])


def test_velocity_needs_enough_pairs(spark):
    rows = [(1, float(t), 2.0 * t) for t in range(1, 6)] + [(2, 1.0, 1.0)]
    got = {r.cell: r.slope for r in slope_through_origin(spark.createDataFrame(rows, "cell int, t double, y double"), ["cell"], "t", "y", 3).collect()}
    assert got == {1: 2.0, 2: None}


def test_contour_follows_a_circle(spark):
    rows = [(r, c, float(np.hypot(r - 10, c - 10))) for r in range(21) for c in range(21)]
    s = contour(spark.createDataFrame(rows, "r int, c int, v double"), "v", 6.0).collect()
    ends = np.array([(x.x1, x.y1) for x in s] + [(x.x2, x.y2) for x in s])
    assert np.abs(np.hypot(ends[:, 0] - 10, ends[:, 1] - 10) - 6).max() < 0.05
    length = sum(np.hypot(x.x1 - x.x2, x.y1 - x.y2) for x in s)
    assert abs(length - 12 * np.pi) < 0.5


def test_parcels_keep_a_steady_wind(spark):
    wind = spark.range(10 * 10 * 3).select((F.col("id") % 10).cast("int").alias("r"), (F.floor(F.col("id") / 10) % 10).cast("int").alias("c"), F.floor(F.col("id") / 100).cast("int").alias("hour"), F.lit(10.0).alias("u"), F.lit(0.0).alias("v"))
    path = parcels(spark.createDataFrame([(1, 2.0, 0.0, 0.0)], "traj_id long, lon double, lat double, hour double"), wind, 6).orderBy("k").collect()
    assert len(path) == 19
    assert math.isclose(path[-1].lon, 2 + 10 * 6 * 3600 / 111_320, rel_tol=1e-9) and path[-1].lat == 0.0


def test_lines_touch_zones_they_only_pass(spark):
    points = spark.createDataFrame([(1, 0, -1.0, 0.5), (1, 1, 3.0, 0.5), (2, 0, 5.0, 5.0), (2, 1, 6.0, 6.0)], "k int, i int, x double, y double")
    zones = rectangles(spark.createDataFrame([(7, 0.0, 0.0, 1.0, 1.0)], "z int, w double, s double, e double, n double"))
    assert [tuple(r) for r in crossed(points, zones, ["k"], "i", "x", "y", "z").collect()] == [(7, 1)]
