"""Contour lines, distances to lines, and masked inputs of fire weather."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions.fire import bui, danger_class, dc_fold, dc_next, dmc_next, ffmc_next, fwi, isi, relative_humidity, wet_bulb
from terravane.functions.indices import index
from terravane.operators.coast import baseline, open_lines
from terravane.operators.folds import fire_weather
from terravane.operators.lines import contour_lines, oriented_contour, ranked
from terravane.operators.paths import contour
from terravane.operators.reach import line_cells, near_cells, served_cells, squared_distances


def chain(ids, closed):
    return list(zip(ids, ids[1:])) + ([(ids[-1], ids[0])] if closed else [])


def test_ranks_of_open_and_closed_chains(spark):
    rng = random.Random(1)
    ids = rng.sample(range(1_000_000), 900)
    parts = [(ids[:1], True), (ids[1:3], False), (ids[3:5], True), (ids[5:250], False), (ids[250:700], True), (ids[700:900], False)]
    links = [x for own, closed in parts for x in chain(own, closed)]
    want = {}
    for own, closed in parts:
        if closed:
            k = own.index(min(own))
            own = own[k:] + own[:k]
        for k, u in enumerate(own if closed else own[:-1]):
            want[u] = (own[0], k, closed)
    rng.shuffle(links)
    got = {r.u: (r.line, r.position, r.closed) for r in ranked(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    assert got == want
    assert ranked(spark.createDataFrame([], "u long, v long")).collect() == []


def test_a_spiral_of_ten_thousand_segments_is_one_line(spark):
    n = 10_000
    got = ranked(spark.range(n).select((F.col("id") * 7919 % 10_007).alias("u"), ((F.col("id") + 1) * 7919 % 10_007).alias("v"))).orderBy("position").collect()
    assert [(r.line, r.position, r.closed) for r in got] == [(0, k, False) for k in range(n)]
    assert [r.u for r in got] == [k * 7919 % 10_007 for k in range(n)]


def grid(spark, f, size=24):
    return spark.createDataFrame([(r, c, float(f(r, c))) for r in range(size) for c in range(size)], "r int, c int, v double")


def test_contours_become_rings_and_lines_in_order(spark):
    cells = grid(spark, lambda r, c: np.hypot(r - 8, c - 8) if c < 18 else 9 - 5 * np.sin(r) * (c < 22))
    rows = contour_lines(cells, "v", 5.3).collect()
    segments = {tuple(round(x, 9) for x in sorted([(r.x1, r.y1), (r.x2, r.y2)])[k]) for r in rows for k in (0, 1)}
    loose = {tuple(round(x, 9) for x in sorted([(r.x1, r.y1), (r.x2, r.y2)])[k]) for r in contour(cells, "v", 5.3).collect() for k in (0, 1)}
    assert segments == loose and len(rows) == contour(cells, "v", 5.3).count()
    lines = {}
    for r in rows:
        lines.setdefault((r.line, r.closed), []).append(r)
    assert len(lines) > 1
    for (_, closed), own in lines.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        for a, b in zip(own, own[1:] + own[:1] if closed else own[1:]):
            assert math.isclose(a.x2, b.x1, abs_tol=1e-9) and math.isclose(a.y2, b.y1, abs_tol=1e-9)
        assert math.isclose(own[0].whole, sum(r.len for r in own))
    ring = max(lines.items(), key=lambda x: x[0][1] * len(x[1]))[1]
    assert abs(ring[0].whole - 2 * math.pi * 5.3) < 0.6


def test_saddles_masks_and_short_lines(spark):
    rng = random.Random(6)
    cells = spark.createDataFrame([(r, c, None if rng.random() < 0.05 else float(rng.random() < 0.5) + rng.random() / 4) for r in range(20) for c in range(20)], "r int, c int, v double")
    segments = oriented_contour(cells, "v", 0.6)
    assert segments.groupBy("u").count().where("count > 1").isEmpty() and segments.groupBy("v").count().where("count > 1").isEmpty()
    assert segments.count() == contour(cells, "v", 0.6).count()
    whole = contour_lines(cells, "v", 0.6)
    assert contour_lines(cells, "v", 0.6, least=3.0).count() == whole.where("whole >= 3").count() < whole.count()
    band = spark.createDataFrame([(r, c) for r in range(10) for c in range(20)], "r int, c int")
    kept = contour_lines(cells, "v", 0.6, band=band).collect()
    assert kept and all(max(r.y1, r.y2) <= 9.5 for r in kept)
    assert contour_lines(cells.where("r < 0"), "v", 0.6).collect() == []


@pytest.mark.parametrize("share", [0.0, 0.002, 0.05, 0.6, 1.0])
def test_distances_are_exact(share):
    rng = np.random.default_rng(3)
    marked = rng.random((37, 51)) < share
    got = squared_distances(marked)
    at = np.argwhere(marked)
    for r in range(37):
        for c in range(51):
            want = ((at - (r, c)) ** 2).sum(1).min() if len(at) else math.inf
            assert got[r, c] == want


def test_tiles_give_what_one_grid_gives(spark):
    rng = random.Random(8)
    marked = {(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(30)}
    df = spark.createDataFrame([*marked, *list(marked)[:5]], "r int, c int")
    for reach, tile in ((7.3, 16), (20.0, 8), (3.0, 256)):
        got = {(r.r, r.c): r.d2 for r in near_cells(df, reach, tile).collect()}
        want = {}
        for r in range(-61, 62):
            for c in range(-61, 62):
                d2 = min((r - a) ** 2 + (c - b) ** 2 for a, b in marked)
                if d2 <= reach * reach:
                    want[r, c] = d2
        assert got == want
    assert near_cells(df.limit(0), 5).collect() == []


def test_lines_mark_every_cell_they_pass(spark):
    rng = random.Random(4)
    lines = [tuple(rng.uniform(-9, 9) for _ in range(4)) for _ in range(40)] + [(2.5, -3.2, 2.5, 4.1), (1.2, 1.3, 1.4, 1.1), (-5.5, 0.5, 6.5, 0.5)]
    got = {(r.r, r.c) for r in line_cells(spark.createDataFrame([*lines, (None, 1.0, 2.0, 3.0)], "x1 double, y1 double, x2 double, y2 double")).collect()}
    sampled = set()
    for x1, y1, x2, y2 in lines:
        for k in range(4001):
            sampled.add((math.floor(y1 + (y2 - y1) * k / 4000), math.floor(x1 + (x2 - x1) * k / 4000)))
    assert sampled <= got and len(got - sampled) <= 3  # samples may step over a corner
    area = served_cells(spark.createDataFrame([(100.0, 100.0, 400.0, 100.0)], "x1 double, y1 double, x2 double, y2 double"), 50.0, 120.0)
    assert math.isclose(area.agg(F.max("distance")).first()[0], 50 * math.sqrt(5)) and area.where("distance = 0").count() == 7


FUNCTIONS = {
    "ffmc": (ffmc_next, (80.0, 25.0, 40.0, 10.0, 1.0)),
    "ffmc_dry": (ffmc_next, (80.0, 25.0, 40.0, 10.0, 0.0)),
    "dmc": (dmc_next, (20.0, 25.0, 40.0, 2.0, 9.0)),
    "dmc_dry": (dmc_next, (20.0, 25.0, 40.0, 0.0, 9.0)),
    "dc": (dc_next, (100.0, 25.0, 5.0, 1.4)),
    "dc_dry": (dc_next, (100.0, 25.0, 0.0, 1.4)),
    "isi": (isi, (85.0, 10.0)),
    "bui": (bui, (20.0, 100.0)),
    "bui_low": (bui, (1.0, 100.0)),
    "fwi": (fwi, (10.0, 40.0)),
    "fwi_low": (fwi, (0.1, 0.5)),
    "rh": (relative_humidity, (25.0, 15.0)),
    "wet": (wet_bulb, (25.0, 60.0)),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_a_masked_input_gives_a_masked_code(spark, name):
    f, values = FUNCTIONS[name]
    rows = [values, *(tuple(None if i == k else v for i, v in enumerate(values)) for k in range(len(values)))]
    names = [f"x{k}" for k in range(len(values))]
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(f(*map(F.col, names)).alias("y")).collect()]
    assert got[0] is not None and not math.isnan(got[0])
    assert got[1:] == [None] * len(values)


def test_masked_bands_and_cells(spark):
    bands = ("green", "red", "nir", "swir1", "swir2", "tir")
    row = (0.1, 0.2, 0.4, 0.3, 0.25, 30.0)
    for name, used in {"EBBI": ("nir", "swir1", "tir"), "NDISI": ("green", "nir", "swir1", "tir"), "IBI": ("green", "red", "nir", "swir1"), "BU": ("red", "nir", "swir1")}.items():
        for hole in used:
            df = spark.createDataFrame([row, tuple(None if b == hole else x for b, x in zip(bands, row))], ", ".join(f"{b} double" for b in bands))
            got = [r[0] for r in df.select(index(name)).collect()]
            assert got[0] is not None and got[1] is None, (name, hole)
    days = [(cell, f"2024-01-0{k}", None if cell == 2 and k == 2 else 25.0 + k, 50.0, 10.0, 0.5 * k) for cell in (1, 2) for k in range(1, 6)]
    df = spark.createDataFrame(days, "cell int, day string, t double, h double, w double, rain double").withColumn("day", F.to_date("day"))
    got = {r.cell: r for r in fire_weather(df, ["cell"]).withColumn("class", danger_class("FWI", F.col("fwi"))).collect()}
    assert None not in tuple(got[1])
    assert tuple(got[2])[2:] == (None,) * 7


def test_one_formula_over_numbers_and_columns(spark):
    days = [(20.0 + k % 9, 7.0 * (k % 4 == 0), 1.4) for k in range(60)]
    values = dc_fold(15.0, days)
    before = [15.0, *values[:-1]]
    df = spark.createDataFrame([(b, *x) for b, x in zip(before, days)], "b double, t double, rain double, f double")
    got = [r[0] for r in df.select(dc_next(*map(F.col, ("b", "t", "rain", "f")))).collect()]
    assert np.allclose(got, values, rtol=1e-12)
    assert np.isnan(dc_fold(15.0, [(20.0, 0.0, 1.4), (math.nan, 0.0, 1.4), (20.0, 0.0, 1.4)])).tolist() == [False, True, True]


def test_lengths_along_lines_are_roots_of_squares(spark):
    """hypot rounds otherwise than SQL's root of squares, which moves points of a baseline where a step ends at a corner."""
    rng = random.Random(3)
    at = [(rng.randrange(81) / 10 + 1, rng.randrange(81) / 10 + 1) for _ in range(2000)]
    points = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(at)], "k long, i long, x double, y double")
    s = open_lines(points, "k", "i", (0.0, 0.0, 10.0, 10.0), 0.0)
    assert {r._i: r.len for r in s.collect()} == {i: math.sqrt((c - a) ** 2 + (d - b) ** 2) for i, ((a, b), (c, d)) in enumerate(zip(at, at[1:]))}
    ends = np.cumsum([math.sqrt((c - a) ** 2 + (d - b) ** 2) for (a, b), (c, d) in zip(at, at[1:])])
    got = baseline(s, ["k", "line"], 2.5).collect()
    assert [r.p for r in sorted(got, key=lambda r: r.p)] == list(range(math.ceil(ends[-1] / 2.5)))
