"""Summaries on tables of other column names."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import functions as F

from terravane.operators import summaries as s

D = datetime.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_frames_captions_and_prices(spark):
    points = spark.createDataFrame([(100.0 + k / 100, 0.0 + k / 100) for k in range(101)] + [(170.0, 60.0)], "px double, py double")
    b = s.display_frame(points, "px", "py", (100.2, 0.2, 100.4, 0.4)).first()
    assert 99.5 < b.w < 100 and 101 < b.e < 101.6 and math.isclose((b.e - b.w) / (b.n - b.s), 1.5)  # the runaway point doesn't set it
    wide = s.display_frame(points, "px", "py", (-180.0, -90.0, 180.0, 90.0)).first()
    assert tuple(wide) == (-180.0, -90.0, 180.0, 90.0)
    names = spark.createDataFrame([("a", 1, "Kapuas"), ("a", 2, "Katingan"), ("a", 3, "Seruyan"), ("b", 1, "x" * 30)], "prov string, rank int, district string")
    assert rows(s.captions(names, "prov", "district", "rank", 16)) == [("a", "Kapuas, Katingan", 2)]
    jobs = spark.createDataFrame([("gamma",)] * 3 + [("burst",)] + [(None,)], "kind string")
    assert rows(s.priced(jobs, "kind", {"gamma": 10}, 15)) == [("burst", 15), ("gamma", 30), (None, 15)]
    assert rows(s.priced(jobs, "kind", {}, 2)) == [("burst", 2), ("gamma", 6), (None, 2)]


def test_cells_and_bands(spark):
    df = spark.createDataFrame([(100.0, -1.0, 110.0, 1.0), (100.0, 0.0, 100.1, 0.1), (100.0, 0.0, None, 0.1)], "w double, s double, e double, n double")
    got = [r[0] for r in df.select(s.auto_cell_km(*map(F.col, "wsen"))).collect()]
    assert math.isclose(got[0], 1113.2 / 380) and got[1:] == [1.0, None]
    bands = spark.createDataFrame([([f"b{k}" for k in range(1, n + 1)],) for n in (4, 8)], "bands array<string>")
    assert rows(bands.select(*s.bands_by_count(F.col("bands")))) == [("b3", "b4"), ("b6", "b8")]


def test_series(spark):
    fires = spark.createDataFrame([(D(2020, 1, 1), "x", 5.0), (D(2020, 1, 9), "x", 7.0), (D(2020, 3, 1), "y", 1.0), (D(2021, 2, 1), "x", 2.0)], "at date, sat string, frp double")
    assert rows(s.cumulative_months(fires, "at")) == [(2020, 1, 2, 2), (2020, 3, 1, 3), (2021, 2, 1, 1)]
    assert rows(s.record_years(fires, "at", 2021)) == [(2021,)] and rows(s.record_years(fires, "at", 1990)) == [(2020,), (2021,)]
    assert rows(s.last_days(fires, "at", 390)) == rows(fires.where("at > date'2020-01-01'"))
    assert rows(s.strongest(fires, ["sat"], "frp", "at", 1).select("frp")) == [(1.0,), (7.0,)]
    assert rows(s.worst_days(fires, "sat", "at", "frp", 1)) == [("x", 7.0, D(2020, 1, 9))]
    assert rows(s.newest_files(fires, "at").select("sat", "covered")) == [("x", D(2021, 2, 28))]
    assert rows(s.daily_stack(fires, "sat", "at", "frp", ["2020-01-09", "2020-03-01"])) == [("x", 7.0, None), ("y", None, 1.0)]
    assert rows(s.annual_heat(fires, ["sat"], "at", "frp")) == [(2020, 3.5, 7.0), (2021, 2.0, 2.0)]
    days = spark.createDataFrame([(D(2020, 1, d),) for d in (1, 2, 3, 10, 11)], "day date")
    assert rows(s.best_window(days, "day", 3)) == [(D(2020, 1, 1), D(2020, 1, 3), 3)]
    stamps = spark.createDataFrame([(datetime.datetime(2020, 1, 1, h),) for h in range(24)] + [(datetime.datetime(2020, 1, 2, 5, m),) for m in (0, 9)], "t timestamp")
    assert rows(s.hour_completeness(stamps, "t")) == [(D(2020, 1, 1), 24, 24, True), (D(2020, 1, 2), 2, 1, False)]
    got = {r.frame.hour: (r.n, round(r.weight, 6)) for r in s.decayed_frames(spark.createDataFrame([(datetime.datetime(2020, 1, 1, 3),), (datetime.datetime(2020, 1, 1, 6),)], "t timestamp"), "t").collect()}
    assert got == {6: (1, 0.75), 12: (2, 0.75), 18: (0, 0.0)} or got == {6: (1, 0.75), 12: (2, 0.75)}


def test_fractions_bins_and_patches(spark):
    people = spark.createDataFrame([("p", "young")] * 1 + [("p", "old")] * 3 + [("q", "old")], "place string, age string")
    totals = spark.createDataFrame([("p", 100.0), ("q", 10.0)], "place string, n double")
    assert rows(s.by_fractions(totals, people, "place", "n", "age", {"young": "young", "old": "old"})) == [("p", 25.0, 75.0), ("q", 0.0, 10.0)]
    v = spark.createDataFrame([(float(k),) for k in range(10)], "v double")
    assert rows(s.equal_bins(v, "v", 2)) == [(0, 5, 0.0, 4.0), (1, 5, 5.0, 9.0)]
    gains = spark.createDataFrame([(k, float(k % 4)) for k in range(8)] + [(99, None)], "pair int, gain double")
    assert [tuple(r) for r in s.best_and_worst(gains, "pair", "gain", 2).collect()] == [("best", 3, 3.0), ("best", 7, 3.0), ("worst", 0, 0.0), ("worst", 4, 0.0)]
    cells = spark.createDataFrame([(0, c, float(c)) for c in range(5)], "r int, c int, ph double")
    assert {r.c: round(r.cm, 6) for r in s.patch_cm(cells, F.col("c") < 3, "ph", 4 * math.pi).collect()} == {0: -1.0, 1: 0.0, 2: 1.0}
    check = s.sign_check(cells.withColumn("other", -2 * F.col("ph")), "ph", "other").first()
    assert (round(check.slope, 9), round(check.r, 9), check.same_sign) == (-2.0, -1.0, False)
    burned = spark.createDataFrame([(0, c, 2020, int(c < 2)) for c in range(4)], "r int, c int, yr int, hit int")
    assert rows(s.burn_rates(burned, cells.where("c IN (0, 2)"), "yr", "hit")) == [(2020, 2, 1, 50.0, 50.0)]
