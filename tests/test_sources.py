"""Readers, sinks and plans on small files written here."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.plans import QUERIES, SQL
from terravane.plans.orchestration import chain, pair_name, pair_plan, run_scenario
from terravane.sources.adapters import weather
from terravane.sources.files import (
    FlatRaster,
    ceos_records,
    control_file,
    detections_csv,
    endpoints,
    geojson_points,
    geojson_polygons,
    run_results,
    to_geojson,
    weather_weeks,
    write_results,
    write_tiles,
)

TDUMP = """     2     1
    GDAS    24     9    22     0     0
    GDAS    24     9    29     0     0
     2 BACKWARD OMEGA
    24     9    25    12   -1.000  110.000   500.0
    24     9    25    12   -2.000  111.000   500.0
     1 PRESSURE
     1     1    24     9    25    12     0     0     0.0   -1.000  110.000   500.0   950.0
     2     1    24     9    25    12     0     0     0.0   -2.000  111.000   500.0   950.0
     1     1    24     9    25    11     0     0    -1.0   -1.100  110.100   510.0   949.0
"""


def test_endpoints(spark, tmp_path):
    (tmp_path / "tdump").write_text(TDUMP)
    rows = endpoints(spark, str(tmp_path / "tdump")).orderBy("traj_id", "at").collect()
    assert [(r.traj_id, r.at.hour, r.lat, r.lon, r.height) for r in rows] == [(1, 11, -1.1, 110.1, 510.0), (1, 12, -1.0, 110.0, 500.0), (2, 12, -2.0, 111.0, 500.0)]
    assert {r.direction for r in rows} == {"BACKWARD"} and rows[0].at.year == 2024


@pytest.mark.parametrize("text", ["", TDUMP + " 1 1 24 9\n"])
def test_bad_endpoint_files_are_errors(spark, tmp_path, text):
    (tmp_path / "tdump").write_text(text)
    with pytest.raises(Exception, match="endpoint"):
        endpoints(spark, str(tmp_path / "tdump")).collect()


def test_weather_weeks_cross_a_year(spark):
    runs = spark.createDataFrame([(1, "2024-01-01 06:00:00", 48, True), (2, "2024-02-28 00:00:00", 48, False)], "k int, start string, hours int, back boolean").withColumn("start", F.col("start").cast("timestamp"))
    got = {(r.k, r.year, r.month, r.week) for r in weather_weeks(runs, "start", "hours", "back").collect()}
    assert got == {(1, 2023, 12, 5), (1, 2024, 1, 1), (2, 2024, 2, 4), (2, 2024, 2, 5), (2, 2024, 3, 1)}


def test_detections(spark, tmp_path):
    for sat in ("a", "b"):
        (tmp_path / sat).write_text(f"latitude,longitude,acq_date,acq_time,confidence,frp\n-1.5,110.5,2024-09-0{1 + (sat == 'b')},{705 if sat == 'a' else 12},n,3.5\n")
    rows = detections_csv(spark, {s: str(tmp_path / s) for s in ("a", "b")}).orderBy("sat").collect()
    assert [(r.sat, r.at.hour, r.at.minute) for r in rows] == [("a", 7, 5), ("b", 0, 12)]


def test_geojson(spark, tmp_path):
    shapes = [("Point", [1, 2]), ("MultiPoint", [[1, 2], [3, 4]]), ("LineString", [[0, 0], [1, 1], [2, 2]]), ("MultiLineString", [[[0, 0], [1, 1]], [[5, 5], [6, 6]]])]
    hole = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]
    feature = lambda t, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": t, "coordinates": c}}
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(t, c, name=t) for t, c in shapes]}))
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", hole, name="A"), feature("MultiPolygon", [hole, hole]), feature("Point", [0, 0])]}))
    counts = {r["name"]: r["count"] for r in geojson_points(spark, str(tmp_path / "p.json")).groupBy("name").count().collect()}
    assert counts == {"Point": 1, "MultiPoint": 2, "LineString": 3, "MultiLineString": 4}
    zones = {r["name"]: len(r.edges) for r in geojson_polygons(spark, str(tmp_path / "z.json")).collect()}
    assert zones == {"A": 7, "zone_2": 14}
    line = to_geojson(spark.range(1), F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")), ["id"]).first().value
    assert json.loads(line) == feature("Point", [1.0, 2.0], id=0)


@pytest.mark.parametrize("order", ["little", "big"])
def test_flat_raster(spark, tmp_path, order):
    data = np.arange(2 * 5 * 7, dtype=float).reshape(2, 5, 7)
    data[0, 0, 0] = -99
    data[1, 4, 6] = np.nan
    data.astype(">f4" if order == "big" else "<f4").tofile(tmp_path / "r.img")
    spark.dataSource.register(FlatRaster)
    df = spark.read.format("flat_raster").options(path=str(tmp_path / "r.img"), width=7, height=5, bands="a,b", order=order, rows=2, nodata=-99).load()
    assert df.rdd.getNumPartitions() == 3
    got = {(r.r, r.c): (r.a, r.b) for r in df.collect()}
    assert len(got) == 35 and got[0, 0] == (None, 35.0) and got[4, 6] == (34.0, None) and got[2, 3] == (17.0, 52.0)


def test_ceos_records(spark, tmp_path):
    record = lambda kind, n: (1).to_bytes(4, "big") + kind + n.to_bytes(4, "big") + b"\0" * (n - 12)
    (tmp_path / "led").write_bytes(record(b"\x3f\xc0\x12\x12", 720) + record(b"\x12\x0a\x12\x14", 4096))
    assert ceos_records(spark, str(tmp_path)).count() == ceos_records(spark, (tmp_path / "led").as_uri()).count() == 2
    rows = ceos_records(spark, str(tmp_path / "led")).orderBy("k").collect()
    assert [(r.kind, r.offset, r.size) for r in rows] == [("3fc01212", 0, 720), ("120a1214", 720, 4096)]


def test_sinks(spark, tmp_path):
    cells = spark.range(1000).select((F.col("id") % 40).cast("int").alias("r"), F.floor(F.col("id") / 40).cast("int").alias("c"))
    write_tiles(cells, str(tmp_path / "tiles"), 16)
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert back.count() == 1000 and back.where("tile_r = 1 AND tile_c = 0").agg(F.min("r"), F.max("c")).first()[:] == (16, 15)
    write_results(spark.createDataFrame([("a", 1.5)], "zone string, pct double"), str(tmp_path / "stats"))
    (tmp_path / "stats" / "broken.json").write_text("{oops")
    assert run_results(spark, str(tmp_path / "stats" / "*.json")).count() == 1
    starts = spark.createDataFrame([("2024-09-25 12:00:00", -1.0, 110.0, 500.0), ("2024-09-25 12:00:00", -2.0, 111.0, 500.0)], "at string, lat double, lon double, height double").withColumn("at", F.col("at").cast("timestamp"))
    text = control_file(starts, -48, 10000, ["/met/gdas1.sep24.w4"], "/out/tdump").first().value.split("\n")
    assert text == ["24 09 25 12", "2", "-1.0000 110.0000 500.0", "-2.0000 111.0000 500.0", "-48", "0", "10000.0", "1", "/met/", "gdas1.sep24.w4", "/out/", "tdump"]


def test_names_do_not_depend_on_order(spark):
    r = spark.range(1).select(pair_name(F.lit("x"), F.lit("y")).alias("a"), pair_name(F.lit("y"), F.lit("x")).alias("b"), pair_name(F.lit("x"), F.lit("y"), F.lit("v2")).alias("c")).first()
    assert r.a == r.b != r.c and len(r.a) == 8


def test_pairs_whose_short_names_collide_are_two(spark):
    scenes = spark.createDataFrame([(101374, 1, 1), (101375, 1, 2), (208944, 2, 1), (208945, 2, 2)], "scene_id long, track int, n int").withColumn("day", F.date_add(F.lit("1995-01-01").cast("date"), F.col("n")))
    name = pair_name(F.col("scene_1"), F.col("scene_2"))
    known = spark.createDataFrame([(101375, 101374)], "scene_1 long, scene_2 long").withColumn("name", name)
    other = spark.createDataFrame([(208944, 208945)], "scene_1 long, scene_2 long").select(name.alias("name"))
    assert known.first().name == other.first().name
    r = pair_plan(scenes, ["track"], 3, 30, known, 10).first()
    assert (r.pairs, r.already, r.price, r.due) == (2, 1, 20, 10)


def test_weather_does_not_jump_where_a_mean_lies_on_a_bound(spark, tmp_path):
    """60 copies of 52.06 and 187.94 have a mean of 120, whose remainders are 0, whatever the order of rows."""
    values = spark.range(120).select(F.lit(123).cast("long").alias("user_id"), F.lit("2024-01-20 10:00:00").cast("timestamp").alias("ts"), F.when(F.col("id") % 2 == 0, 52.06).otherwise(187.94).alias("value"), "id")
    for k, order in enumerate((["id"], ["value"], ["id"])):
        values.orderBy(*order).coalesce(1).repartition(1 + 2 * k).select("user_id", "ts", "value").write.parquet(f"{tmp_path}/{k}/events.parquet")
        r = weather(spark, f"{tmp_path}/{k}").first()
        assert (r.t, r.w, r.rain) == (20.0, 0.0, 52.06)
    odd = spark.createDataFrame([(1, 1e300), (1, 3e300), (2, 0.1234567890123), (2, None), (3, None), (4, float("nan"))], "user_id long, value double").withColumn("ts", F.lit("2024-01-20 10:00:00").cast("timestamp"))
    odd.write.parquet(f"{tmp_path}/odd/events.parquet")
    got = {r.cell: r.w for r in weather(spark, f"{tmp_path}/odd").collect()}
    assert got[1] == 2e300 % 20 and got[2] == 0.1234567890123 and got[3] is None and got[4] != got[4]


@pytest.mark.parametrize("name", ["fn8_humidity", "rc1_fire_weather", "rc1_masked_weather", "rc2_drought_code", "st8_drought_state"])
def test_few_values_of_a_day_are_summed_in_the_order_of_rows(spark, tmp_path, name):
    """5.68, 59.05 and 25.27 have a sum just below 90 one after another, and 90 backwards: with a mean by 30, remainders jump as those of the SQL in the same order."""
    rows = [(1, 5.68), (2, 25.27), (3, 1.0), (1, 59.05), (2, 59.05), (3, None), (1, 25.27), (2, 5.68)]
    for k, (user, value) in enumerate(rows):
        one = spark.createDataFrame([(user, value)], "user_id long, value double").withColumn("ts", F.lit("2024-01-20 10:00:00").cast("timestamp_ntz"))
        one.coalesce(1).write.parquet(f"{tmp_path}/{k}")
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        next((tmp_path / str(k)).glob("*.parquet")).rename(tmp_path / f"events.parquet/{k}.parquet")
    assert {r.cell: round(r.t, 6) for r in weather(spark, str(tmp_path)).collect()} == {1: 35.0, 2: 20.0, 3: 21.0}
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scenarios_check_what_they_need(spark, sf):
    with pytest.raises(ValueError, match="needs split"):
        run_scenario("burn", spark, sf_dir=sf)
    with pytest.raises(ValueError, match="no scenario"):
        run_scenario("volcano", spark)
    done, failed = chain(spark, [("a", "burn", {"sf_dir": sf, "split": "1996-01-01"}), ("b", "water", {"sf_dir": sf})])
    assert done["a"].count() == 1 and "needs split" in failed["b"]
