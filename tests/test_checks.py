"""What is settled before data are read, texts and ledgers that are written, and statistics without a twin in SQL."""

from __future__ import annotations

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import checks
from terravane.operators.overlay import block_factor, lattice_offset
from terravane.operators.quantiles import quantiles
from terravane.operators.stacks import bootstrap
from terravane.plans.orchestration import SCENARIOS, run_scenario
from terravane.plans.scenarios import STEPS, brief, fire_season
from terravane.sources import places, sinks
from terravane.streaming.feeds import stream
from terravane.streaming.jobs import known_jobs, submit, submitting

DAY = datetime.date(2026, 3, 1)


@pytest.mark.parametrize("call", [
    lambda: checks.chosen_area({}),
    lambda: checks.checked_box("1,2,3"),
    lambda: checks.checked_box("a,b,c,d"),
    lambda: checks.checked_box("10,5,9,6"),
    lambda: checks.checked_box("0,-91,1,2"),
    lambda: checks.checked_season(DAY, DAY + datetime.timedelta(30), 29),
    lambda: checks.checked_season(DAY, DAY, 60),
    lambda: checks.checked_epochs([2000, 2010]),
    lambda: checks.checked_epochs([2010, 2000, 2020]),
    lambda: checks.checked_receptors("forward", ["a"]),
    lambda: checks.checked_scale(1000, {"rain": 5566, "soil": 11132}),
    lambda: places.site("nowhere"),
    lambda: lattice_offset((0, 0), (0.3, 0), 0.5),
    lambda: run_scenario("haze", None),
    lambda: run_scenario("no such scenario", None),
])
def test_refused(call):
    with pytest.raises(ValueError):
        call()


def test_accepted():
    assert checks.chosen_area({"bbox": "1,2,3,4", "city": "x", "site": ""}) == ("city", "x")
    assert checks.checked_box("100,-5,101.5,-4") == (100, -5, 101.5, -4)
    checks.checked_season(DAY, DAY + datetime.timedelta(30), 30)
    checks.checked_epochs([2000, 2010, 2020])
    checks.checked_receptors("backward", ["a"])
    assert checks.checked_scale(11132, {"rain": 5566, "soil": 11132}) == 11132
    w, s, e, n = checks.box_around(110, 0, 111.32)
    assert math.isclose(e - w, 2) and n > s
    assert places.site(" Harbour ")[2] == 8
    assert lattice_offset((100, -10), (99, -8.5), 0.5) == (3, -2)
    assert [block_factor(20, 20, m) for m in (400, 399, 100, 99, 1)] == [1, 2, 2, 4, 16]


def test_area_by_two_levels(spark):
    z = spark.createDataFrame([("Java", "Semarang"), ("Riau", "Java")], "first string, second string")
    assert [r.second for r in checks.resolved(z, " JAVA", "first", "second").collect()] == ["Semarang"]
    assert [r.level for r in checks.resolved(z, "semarang", "first", "second").collect()] == [2]
    with pytest.raises(ValueError, match="nothing found"):
        checks.some(checks.resolved(z, "Bali", "first", "second"), "Bali")
    with pytest.raises(ValueError, match="has no column zone"):
        checks.checked_columns(z, ["zone"], "the zone layer")


def test_incomplete_season_is_refused(spark):
    wanted = [datetime.date(2026, 1, 5) + datetime.timedelta(15 * k) for k in range(15)]
    kept = spark.createDataFrame([(x,) for x in wanted[:9]], "day date")
    with pytest.raises(ValueError, match="6 of 15 checkpoints are missing: 2026-05-20"):
        checks.complete_season(kept, "day", wanted)
    whole = spark.createDataFrame([(x,) for x in wanted], "day date")
    assert checks.complete_season(whole, "day", wanted) is whole


def test_steps_and_ids():
    ran = []

    def fail():
        raise RuntimeError("no data")

    states = checks.run_steps([("a", True, lambda: ran.append("a")), ("b", False, fail), ("c", True, fail), ("d", True, lambda: ran.append("d"))])
    assert states == {"a": "done", "b": "failed: no data", "c": "failed: no data", "d": "not run"} and ran == ["a"]
    at = datetime.datetime(2026, 3, 1, 4, 5, 6)
    one, two = (checks.run_id("haze", "Kota Semarang", at) for _ in range(2))
    assert one.startswith("20260301-040506_haze_kota-semarang_") and one != two
    assert checks.step_dates(DAY) == {"end": DAY, "haze_start": datetime.date(2025, 12, 1), "drought_start": datetime.date(2025, 8, 3), "forecast_end": datetime.date(2026, 3, 5)}


def test_chain_of_seven(spark, sf):
    assert len(SCENARIOS) == 26
    done, failed, dates = fire_season(spark, sf, DAY)
    assert set(done) == {x[0] for x in STEPS} and not failed
    assert dates["haze"] == DAY - datetime.timedelta(90) and dates["record"] == DAY + datetime.timedelta(4)
    lines = {r.step: r.text for r in brief({"haze": done["haze"]}, {"drought": "ValueError: no rain"}).collect()}
    assert lines == {"haze": "1 rows", "drought": "ValueError: no rain"}


def test_jobs_are_submitted_once(spark, tmp_path):
    ledger, sent = str(tmp_path / "ledger"), []
    jobs = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    send = lambda df: sent.append(sorted(r.name for r in df.collect()))
    submit(jobs("a", "b", "b"), ledger, 0, send)
    submit(jobs("a", "c"), ledger, 1, send)
    submit(jobs("a", "c"), ledger, 1, send)  # again, as after a crash
    assert sent == [["a", "b"], ["c"], ["c"]]
    assert sorted(map(tuple, known_jobs(spark, ledger).collect())) == [("a", 0), ("b", 0), ("c", 1)]
    jobs("x", "y").coalesce(1).write.parquet(str(tmp_path / "in"))
    submitting(stream(spark, str(tmp_path / "in")), str(tmp_path / "other"), str(tmp_path / "state")).awaitTermination()
    assert {r.name for r in known_jobs(spark, str(tmp_path / "other")).collect()} == {"x", "y"}


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.5), (0, 1, None)], "r int, c int, v double")
    sinks.write_csv(cells, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "csv"), header=True, schema="r int, c int, v double").collect()), key=str) == [(0, 0, 1.5), (0, 1, None)]
    text = sinks.markdown(cells, ["c", "v"], ["c"])
    assert text == "| c | v |\n|-|-|\n| 0 | 1.5 |\n| 1 | - |\n"
    with pytest.raises(ValueError):
        sinks.markdown(cells, ["c"], ["c"], 1)
    assert "<h2>a &amp; b</h2><pre>x &lt; y</pre>" in sinks.page("t", [("a & b", "x < y")])
    raster = sinks.class_raster(spark.createDataFrame([(0, 0, 1), (0, 1, None)], "r int, c int, k int"), "k", {1: "#ff0000"})
    assert [tuple(r) for r in raster.orderBy("c").collect()] == [(0, 0, 1, "#ff0000"), (0, 1, 255, None)]
    files = spark.createDataFrame([("Q", "q_inc_map.tif"), ("P", "p_unw_phase.tif"), ("P", "p_inc_map.tif")], "product string, name string")
    config = sinks.series_config(files, "product", "name", "/d")
    assert "unwFile = /d/*/*_unw_phase.tif" in config and "corFile = /d/*/*_corr.tif" in config and "demFile" not in config and "incAngleFile = /d/P/p_inc_map.tif" in config


def test_streets(spark, tmp_path):
    nodes = [{"type": "node", "id": k, "lat": 0.0, "lon": 0.001 * k, **({"tags": {"railway": "halt"}} if k == 2 else {})} for k in range(4)]
    ways = [{"type": "way", "id": 9, "nodes": [0, 1, 2], "tags": {"highway": "footway"}}, {"type": "way", "id": 8, "nodes": [2, 3], "tags": {"highway": "motorway"}}]
    (tmp_path / "streets.json").write_text(json.dumps({"elements": nodes + ways}))
    order, stops = places.street_ways(spark, str(tmp_path))
    assert [(r.way, r.k, r.node) for r in order.orderBy("k").collect()] == [(9, 0, 0), (9, 1, 1), (9, 2, 2)]
    assert [r.node for r in stops.collect()] == [2]


def test_detections_in_a_box(spark):
    d = spark.createDataFrame([(101.0, 1.0, "b"), (100.0, 0.0, "a"), (103.0, 1.0, "c")], "lon double, lat double, at string")
    assert [r["at"] for r in places.detections_in(d, (100, 0, 102, 2)).collect()] == ["a", "b"]


def test_product_files(spark, tmp_path):
    for product, name in (("P1", "P1_unw_phase.tif"), ("P1", "P1.txt"), ("P2", "P2_corr.tif")):
        (tmp_path / product).mkdir(exist_ok=True)
        (tmp_path / product / name).write_bytes(b"12345")
    got = sorted((r.product, r.band, r.bytes) for r in places.product_files(spark, str(tmp_path)).collect())
    assert got == [("P1", "", 5), ("P1", "unw_phase", 5), ("P2", "corr", 5)]


def test_footprint(spark):
    """A satellite over the equator that flies north looks east."""
    r = 6378137.0 + 700_000
    s = spark.createDataFrame([(1, 0, r, 0.0, 0.0, 0.0, 0.0, 7500.0), (1, 10, r, 0.0, 0.0, 0.0, 0.0, 7500.0)], "k int, t int, x double, y double, z double, vx double, vy double, vz double")
    ring = places.footprints(s, "k", 800_000.0, 900_000.0).first().ring
    near, far = ring[0], ring[2]
    assert 0 < near.lon < far.lon < 10 and abs(near.lat) < 1e-9 and ring[0] == ring[4]
    angle = math.radians(near.lon)
    assert math.isclose(math.dist((r, 0), (6378137.0 * math.cos(angle), 6378137.0 * math.sin(angle))), 800_000, rel_tol=1e-9)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(0, 1, 999), rng.integers(0, 5, 400).astype(float), np.array([3.0]), np.append(rng.normal(0, 1, 100), 1e9)):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double")
        got = quantiles(df, "v", {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}).first()
        assert got.n == len(values)
        assert np.allclose([got[k] for k in "abcde"], np.quantile(values, [0, 0.05, 0.5, 0.951, 1.0]))


def test_bootstrap_draws_blocks(spark):
    """Counts of a block over many draws are those of a Poisson law of mean 1, and a draw is the mean over its blocks."""
    df = spark.range(40).select("id", (F.col("id") % 4 * 0.1).alias("phase"))
    got = bootstrap(df, "id", "phase", 400).orderBy("replicate").collect()
    again = bootstrap(df.repartition(3), "id", "phase", 400).orderBy("replicate").collect()
    assert len(got) == 400 and np.allclose([r.direction for r in got], [r.direction for r in again], atol=1e-12)
    mean = math.atan2(np.sin([0, 0.1, 0.2, 0.3]).mean(), np.cos([0, 0.1, 0.2, 0.3]).mean())
    directions = np.array([r.direction for r in got])
    assert abs(directions.mean() - mean) < 0.005 and 0.5 < directions.std() / (0.1118 / math.sqrt(40)) < 1.5
    assert all(0.9 < r.length <= 1 for r in got)
