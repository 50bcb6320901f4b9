"""Assessments on tables of other column names, and scenarios whose options have an effect."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from terravane.operators import assess
from terravane.plans.orchestration import SCENARIOS, run_scenario
from terravane.plans.scenarios import BUILT_BY, UNDATED, fire_season, season_claims

D = datetime.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_flood_and_disturbance(spark):
    db = lambda x: 10 ** (x / 10)
    obs = [(r, c, D(2020, m, 1), db(-10.0 if m == 1 or c > 4 else -18.0)) for r in range(3) for c in range(8) for m in (1, 6)] + [(9, 9, D(2020, 6, 1), -1.0)]
    obs = spark.createDataFrame(obs, "r int, c int, taken date, sigma double")
    assert assess.flood(obs, "2020-03-01", "sigma", "taken").count() == 15
    assert assess.flood(obs, "2020-03-01", "sigma", "taken", least=16).count() == 0
    assert assess.flood(obs, "2020-03-01", "sigma", "taken", threshold=-19).count() == 0
    land = spark.createDataFrame([(r, c) for r in range(3) for c in (0, 1, 2)], "r int, c int")
    assert assess.flood(obs, "2020-03-01", "sigma", "taken", land=land).count() == 9
    slopes = spark.createDataFrame([(r, c, 20.0 if r else 5.0) for r in range(3) for c in range(8)], "r int, c int, slope double")
    got = assess.disturbance(obs, slopes, F.month("taken") > 3, "sigma").groupBy("grade", "steep").count()
    assert rows(got) == [(0, False, 3), (0, True, 6), (2, False, 5), (2, True, 10)]
    assert assess.disturbance(obs, slopes, F.month("taken") > 3, "sigma", severe=-9).where("grade = 1").count() == 15


def test_growth_and_greenness(spark):
    obs = spark.createDataFrame([(k, y, *v) for k, (a, b) in enumerate([((0.5, 0.0), (0.1, 0.4)), ((0.5, 0.0), (0.45, 0.0)), ((0.1, 0.3), (0.1, 0.3)), ((0.5, 0.1), (0.19, None))]) for y, v in ((1990, a), (2000, b))], "k int, y int, green double, built double")
    got = assess.urban_growth(obs, F.col("y") < 1995, F.col("y") > 1995, "green", "built", keys=["k"], km2=1.0)
    assert rows(got) == [(2, 1, 1.0, 2.0)]
    assert rows(assess.urban_growth(obs, F.col("y") < 1995, F.col("y") > 1995, "green", "built", keys=["k"], fall=-0.35, km2=1.0)) == [(1, 1, 1.0, 2.0)]
    g = assess.greenness(obs, F.col("y") < 1995, F.col("y") > 1995, F.col("green"), ["k"], shown="built")
    assert rows(assess.close_up(g, "shown", ["k"], low=0.0, high=1.0).select("k", "lost")) == [(0, True), (1, False), (2, False), (3, True)]
    masked = assess.close_up(g.withColumn("shown", F.when(F.col("k") > 0, F.col("shown"))), "shown", ["k"])
    assert masked.where("k = 0").first().shown is None
    c = assess.greenness_change(g, affected=-0.2, severe=-0.35).first()
    assert (c.pct_affected, c.pct_severe) == (50.0, 25.0) and math.isclose(c.change, -0.19)


def test_rain(spark):
    rain = spark.createDataFrame([(1, y, float(v)) for y, v in ((2001, 10), (2002, 20), (2003, 30), (2004, 20))] + [(2, 2004, 5.0)], "place int, y int, mm double")
    one = rain.where("place = 1")
    got = {r.y: (round(r.z, 6), r.pct, r.driest) for r in assess.rain_by_year(one, F.col("y"), "mm").collect()}
    assert got == {2001: (round(-math.sqrt(2), 6), 50.0, 1), 2002: (0.0, 100.0, 2), 2003: (round(math.sqrt(2), 6), 150.0, 4), 2004: (0.0, 100.0, 2)}
    assert rows(assess.percent_of_normal(rain, ["place"], F.col("y"), "mm", 2004)) == [(1, 100.0), (2, None)]


def test_anomalies_and_heat(spark):
    sea = spark.createDataFrame([(lon, D(y, m, 1), float(m + (y - 2000) * (lon < 120))) for lon in (100, 140) for y in (2000, 2001, 2002) for m in (1, 2)], "lon int, month date, sst double")
    got = {(r.y, r.m): r.anomaly for r in assess.box_anomaly(sea, F.col("lon") < 120, "month", "sst").collect()}
    assert got == {(y, m): y - 2001.0 for y in (2000, 2001, 2002) for m in (1, 2)}
    west = {r.month.year: r.dipole for r in assess.dipole(sea, F.col("lon") < 120, F.col("lon") > 120, "month", "sst").collect()}
    assert west == {2000: -1.0, 2001: 0.0, 2002: 1.0}
    cells = spark.createDataFrame([(True, 30.0, 10.0), (True, 32.0, 30.0), (False, 25.0, 60.0), (False, 10.0, 900.0), (False, None, 20.0)], "city boolean, lst double, metres double")
    h = assess.heat_island(cells, F.col("city"), "lst", "metres").first()
    assert (h.urban, h.rural, h.suhii, h.n_rural) == (31.0, 25.0, 6.0, 2)
    assert assess.heat_island(cells, F.col("city"), "lst").first().rural == 17.5


def test_coherence_and_centroids(spark):
    pairs = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.2), ("b", 1, 0.5), ("b", 2, 0.4), ("c", 1, 0.1), ("c", 2, 0.0)], "px string, k int, gamma double")
    got = assess.coherence_drop(pairs, ["px"], F.col("k") > 1, "gamma", cell_ha=0.5).first()
    assert (got.usable, got.fell, got.ha, got.pct) == (2, 1, 0.5, 50.0) and math.isclose(got.p05, 0.1) and math.isclose(got.p95, 0.64)
    v = spark.createDataFrame([(1, [0.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [9.0, 9.0], "y"), (4, [1.0, 1.0], "y"), (5, [8.0, 9.0], "y")], "id int, f array<double>, kind string")
    assert rows(assess.nearest_centroids(v, "id", "f", "kind", F.col("id") <= 3)) == [(4, "y", "x"), (5, "y", "y")]


def test_areas_years_and_shares(spark):
    cells = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, True), (None, True)], "ndvi double, wet boolean")
    a = assess.area_reducers(cells, "ndvi", "wet", 0.5).first()
    assert (a.n, a.valid, a.mean, a.total, a.least, a.most, a.quantile) == (4, 3, 2.0, 6.0, 1.0, 3.0, 2.0) and math.isclose(a.pct_mask, 200 / 3)
    fires = spark.createDataFrame([(D(y, m, 1), 2.0) for y, n in ((2001, 1), (2002, 3), (2003, 4)) for m in range(1, n + 1)] + [(D(2001, 12, 1), 1.0)], "at date, ha double")
    got = {r.y: (r.n, r.against_mean, r.against_recent, r.rank) for r in assess.year_to_date(fires, "at", "01-01", "07-01", 2003, 2002).collect()}
    assert got == {2001: (1, 0.5, 1 / 3, 3), 2002: (3, 1.5, 1.0, 2), 2003: (4, 2.0, 4 / 3, 1)}
    assert rows(assess.share_of_total(fires, ["at"], "ha").where("at = date'2003-01-01'").select("total")) == [(2.0,)]
    houses = spark.createDataFrame([(10.0, 10.0, 5.0, 0.9), (399.0, 1.0, 7.0, 0.7), (401.0, 1.0, 1.0, 0.8), (1.0, 1.0, 9.0, 0.69)], "e double, n double, m2 double, p double")
    assert rows(assess.building_grid(houses, F.col("e"), F.col("n"), "m2", confidence="p")) == [(0, 0, 2, 12.0), (1, 0, 1, 1.0)]


def test_haze_dates_and_states(spark):
    air = spark.createDataFrame([(D(2020, 1, k), v) for k, v in ((1, 10.0), (2, 60.0), (3, 300.0), (4, 20.0), (5, None))], "d date, ug double")
    h = assess.haze_run(air, "d", "ug").first()
    assert (h.days, h.mean, h.most, h.worst_day, h.latest, h.has_latest) == (5, 97.5, 300.0, D(2020, 1, 3), None, False)
    assert [h[f"class_{k}"] for k in range(5)] == [1, 1, 1, 0, 1] and h.above_who == 3
    assert assess.haze_run(air, "d", "ug", who=50).first().above_who == 2
    assert rows(assess.newest(air, [], "d", "2020-01-27")) == [(D(2020, 1, 5), D(2020, 1, 4), True)]
    obs = spark.createDataFrame([(0, 0, D(2020, 1, 1), True), (0, 1, D(2020, 1, 1), False), (0, 2, D(2020, 5, 1), True)], "r int, c int, on date, ok boolean")
    assert {r.state: r.cells for r in assess.imagery_state(obs, "2020-01-01", "2020-02-01", F.col("ok"), "on").collect()} == {"clear": 1, "all cloudy": 1, "no pass": 1}


def test_claims_follow_the_numbers(spark):
    zones = spark.createDataFrame([("APL", 1_393_456.0, 20.0, 80.0), ("HP", 900_000.0, 70.0, 30.0), ("AIR", 300.0, 0.0, 100.0)], "zone string, ha double, low double, extreme double")
    crossed = spark.createDataFrame([("APL", D(2026, 2, 3), False), ("HP", D(2026, 1, 1), True), ("AIR", None, None)], "zone string, crossed date, censored boolean")
    got = [r.claim for r in assess.claims(zones, "zone", "ha", ["low", "extreme"], {"DC": crossed}).collect()]
    assert sorted(got) == [
        "APL: 80.0 % of 1,393,456 ha in class extreme, the most of all zones",
        "APL: DC crossed its threshold on 2026-02-03",
        "HP: 30.0 % of 900,000 ha in class extreme",
        "HP: DC stood over its threshold on the first day of the record already",
    ]


def test_options_change_results_and_unknown_ones_are_refused(spark, sf):
    run = lambda name, **o: rows(run_scenario(name, spark, sf_dir=sf, **o))
    flood = run("flood")
    assert run("flood", threshold=-13.0, least=3) == flood != run("flood", threshold=-12.5)
    assert run("haze", who=100.0) != run("haze")
    assert run("fire-hotspot", confidence=90) != run("fire-hotspot")
    assert run("fire-hotspot", box=(100.0, -10.0, 104.0, 0.0)) != run("fire-hotspot")
    assert run("imagery", start="1996-03-01", end="1996-04-01") != run("imagery")
    assert run("haze", start=D(2024, 1, 10), end=D(2024, 1, 12))[0][0] == 3
    for name, options in (("flood", {"colour": 1}), ("transit-access", {"end": D(2024, 1, 1)}), ("burn", {"split": "1996-01-01", "threshold": 1})):
        with pytest.raises(ValueError, match="takes no option"):
            run(name, **options)
    dated = [n for n, q in BUILT_BY.items() if q not in UNDATED]
    assert all({"end"} <= SCENARIOS[n].takes for n in dated) and len(dated) == 19


def test_the_chains_end_reaches_every_step(spark, sf):
    one, two = (fire_season(spark, sf, D(2024, 1, day))[0] for day in (6, 20))
    for step in ("danger", "hotspots", "haze", "exposure", "record"):
        assert rows(one[step]) != rows(two[step]), step
    one, two = (fire_season(spark, sf, D(year, 6, 1))[0] for year in (1995, 1997))
    for step in ("history", "drought"):
        assert rows(one[step]) != rows(two[step]), step
    claims = season_claims(fire_season(spark, sf, D(2024, 1, 20))[0]).collect()
    assert claims and sum("the most of all zones" in r.claim for r in claims) == 1
