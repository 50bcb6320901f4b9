"""Files of zones, rasters and radar products: written here, read back."""

from __future__ import annotations

import math
import os
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

from terravane.operators.coast import shifted_epochs, transects_of_lines
from terravane.operators.zonal import within
from terravane.sources.leader import images, leaders, scene_footprints, scenes
from terravane.sources.products import ENVI_TYPES, geojson_lines, headed_raster, judged, pair_stats, rejects, subfaults
from terravane.sources.rasterfiles import Grid, Tiff, coarse_factor, read_raster, tiff_bytes, write_raster
from terravane.sources.tables import register_lines, register_tables
from terravane.sources.zonefiles import ZoneReader, rings, zones_in


def polygon(ring, order="<", z=False):
    points = b"".join(struct.pack(f"{order}{2 + z}d", *p, *([7.0] * z)) for p in ring)
    return struct.pack(f"{order}BIII", order == "<", 1003 if z else 3, 1, len(ring)) + points


def square(x, y, size=0.8):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def geopackage(path, features):
    """A layer of features (id, name, code, rings), with its spatial index."""
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('areas', 'geom')")
    db.execute("CREATE TABLE areas (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, code INTEGER, share REAL)")
    db.execute("CREATE VIRTUAL TABLE rtree_areas_geom USING rtree(id, minx, maxx, miny, maxy)")
    for k, name, code, own in features:
        blob = None
        if own:
            blob = polygon(own[0]) if len(own) == 1 else struct.pack("<BII", 1, 6, len(own)) + b"".join(polygon(r, ">", True) for r in own)
            xs, ys = [p[0] for r in own for p in r], [p[1] for r in own for p in r]
            blob = b"GP\0\x03" + struct.pack("<i4d", 4326, min(xs), max(xs), min(ys), max(ys)) + blob
            db.execute("INSERT INTO rtree_areas_geom VALUES (?, ?, ?, ?, ?)", (k, min(xs), max(xs), min(ys), max(ys)))
        db.execute("INSERT INTO areas VALUES (?, ?, ?, ?, ?)", (k, blob, name, code, k / 2))
    db.commit()
    db.close()


@pytest.fixture(scope="module")
def zone_file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zones") / "areas.gpkg")
    features = [(100 * r + c + 1, f"zone {r} {c}" if c % 7 else None, r * c, [square(c, r)]) for r in range(50) for c in range(50)]
    features += [(9001, "two", 1, [square(100.0, 0.0), square(103.0, 2.0)]), (9002, "none", 2, [])]
    geopackage(path, features)
    return path


def test_a_small_box_reads_few_features(spark, zone_file):
    reader = ZoneReader({"path": zone_file, "rows": "5"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("e",), 10.5), LessThanOrEqual(("w",), 13.5), GreaterThanOrEqual(("n",), 20.5), LessThanOrEqual(("s",), 22.5), LessThanOrEqual(("code",), 3)]))
    assert len(left) == 5
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 12 and len(parts) == 3  # of 2,502
    whole = zones_in(spark, zone_file, rows=400)
    assert whole.count() == 2502 and whole.rdd.getNumPartitions() == 7
    box = zones_in(spark, zone_file, (10.5, 20.5, 13.5, 22.5))
    got = sorted((r.fid, r.name, r.code, r.share) for r in box.collect())
    assert got == sorted((100 * r + c + 1, f"zone {r} {c}" if c % 7 else None, r * c, (100 * r + c + 1) / 2) for r in (20, 21, 22) for c in (10, 11, 12, 13))
    assert zones_in(spark, zone_file, (-9, -9, -8, -8)).collect() == []
    assert zones_in(spark, zone_file, (10.8, 20.8, 10.8, 20.8)).count() == 1  # borders belong to it


def test_zones_of_a_file_hold_points(spark, zone_file):
    two = zones_in(spark, zone_file, (99, -1, 110, 9))
    row = two.collect()[0]
    assert len(row.edges) == 8 and (row.w, row.s, row.e, row.n) == (100.0, 0.0, 103.8, 2.8)
    assert zones_in(spark, zone_file).where("fid = 9002").select("edges", "w").collect()[0] == ([], None)
    points = spark.createDataFrame([(1, 12.4, 21.4), (2, 12.9, 21.9), (3, 103.1, 2.1), (4, 101.5, 1.0)], "k int, lon double, lat double")
    got = {r.k: r.fid for r in within(points, zones_in(spark, zone_file).where("size(edges) > 0").select("fid", "edges"), "lon", "lat", ["k"], "fid", keep_outside=False).collect()}
    assert got == {1: 2113, 3: 9001}


def test_geometries_in_both_byte_orders():
    ring = square(1.0, 2.0)
    for order in "<>":
        for z in (False, True):
            assert [x.tolist() for x in rings(polygon(ring, order, z))] == [[list(p) for p in ring]]
    assert rings(b"") == [] and rings(struct.pack("<BIdd", 1, 1, 0.0, 0.0)) == []


def cells_of(spark, values, parts=4):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "r int, c int, value double").repartition(parts)


def back(spark, path):
    return {(r.r, r.c): r.value for r in read_raster(spark, path).collect()}


@pytest.mark.parametrize("palette", [None, {0: (1, 2, 3), 7: (200, 100, 0)}])
def test_rasters_are_read_as_they_were_written(spark, tmp_path, palette):
    rng = np.random.default_rng(2)
    values = (rng.random((70, 110)) * 100).astype(np.float32).astype(float) if palette is None else rng.choice([0.0, 7.0], (70, 110))
    values[rng.random(values.shape) < 0.1] = np.nan
    path, grid = str(tmp_path / "raster"), Grid(95.0, 5.0, 0.25, 0.25)
    assert write_raster(cells_of(spark, values), path, grid, palette=palette, block=32) == 1
    got = back(spark, path)
    assert all(got.get(k) == (None if np.isnan(v) else v) for k, v in np.ndenumerate(values)) and len(got) == 7700
    files = [f for f in os.listdir(path) if f.startswith("blocks-")]
    assert len(files) == 1 and len(os.listdir(f"{path}/{files[0]}")) == 12 and not [f for f in os.listdir(path) if f.startswith(".")]
    one = next(f for f in os.listdir(f"{path}/{files[0]}") if f.startswith("1_2-"))
    raw = open(f"{path}/{files[0]}/{one}", "rb").read()
    tiff = Tiff(lambda at, n: raw[at : at + n])
    assert tiff.grid() == Grid(95.0 + 64 * 0.25, 5.0 - 32 * 0.25, 0.25, 0.25)
    if palette:
        assert [tiff.tags[320][k + 256 * b] // 257 for k in (0, 7) for b in range(3)] == [1, 2, 3, 200, 100, 0]
    some = read_raster(spark, path).where("r >= 40 AND r < 50 AND c <= 12")
    assert some.count() == 130
    write_raster(cells_of(spark, values + 1), path, grid, palette=palette, block=64)  # replaces it, old blocks and all
    got = back(spark, path)
    assert all(got[k] == (None if np.isnan(v) else np.float32(v + 1)) for k, v in np.ndenumerate(values) if k in got)
    assert len([f for f in os.listdir(path) if f.startswith("blocks-")]) == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "raster")
    values = np.arange(6400.0).reshape(80, 80)
    cells = cells_of(spark, values)
    broken = cells.withColumn("value", F.when((F.col("r") == 79) & (F.col("c") == 79), F.raise_error(F.lit("broken cell"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken cell"):
        write_raster(broken, path, block=16)
    assert not os.path.exists(path)
    write_raster(cells, path, block=16)
    before = back(spark, path)
    with pytest.raises(Exception, match="broken cell"):
        write_raster(broken, path, block=16)
    assert back(spark, path) == before and len(os.listdir(path)) == 2


def test_rasters_are_coarsened_until_they_fit(spark, tmp_path):
    values = np.arange(48.0 * 40).reshape(48, 40)
    cells = cells_of(spark, values)
    assert [coarse_factor(cells, n) for n in (1920, 1919, 480, 120)] == [1, 2, 2, 4]
    with pytest.raises(ValueError, match="don't fit"):
        coarse_factor(cells, 4)
    path = str(tmp_path / "coarse")
    assert write_raster(cells, path, most=500) == 2
    got = back(spark, path)
    assert got == {(r, c): values[2 * r : 2 * r + 2, 2 * c : 2 * c + 2].mean() for r in range(24) for c in range(20)}


def test_other_tiffs(spark, tmp_path):
    """Plain strips of big-endian 16-bit numbers, as other programs write them."""
    values = np.arange(15, dtype=">u2").reshape(5, 3)
    strips = [values[:2].tobytes(), values[2:4].tobytes(), values[4:].tobytes()]
    tags = [(256, 3, (3,)), (257, 3, (5,)), (258, 3, (16,)), (259, 3, (1,)), (262, 3, (1,)), (273, 4, None), (277, 3, (1,)), (278, 3, (2,)), (279, 4, tuple(map(len, strips)))]
    at = 8 + 2 + 12 * len(tags) + 4
    starts = (at + 24, at + 24 + len(strips[0]), at + 24 + len(strips[0]) + len(strips[1]))
    head = struct.pack(">2sHIH", b"MM", 42, 8, len(tags))
    for tag, kind, v in tags:
        v = starts if v is None else v
        head += struct.pack(">HHI", tag, kind, len(v)) + (struct.pack(">I", at if tag == 273 else at + 12) if len(v) > 1 else struct.pack(">HH" if kind == 3 else ">I", *v, *([0] * (kind == 3))))
    (tmp_path / "a.tif").write_bytes(head + b"\0" * 4 + struct.pack(">3I", *starts) + struct.pack(">3I", *map(len, strips)) + b"".join(strips))
    assert back(spark, str(tmp_path / "a.tif")) == {k: float(v) for k, v in np.ndenumerate(values)} == back(spark, str(tmp_path))
    raw = tiff_bytes(np.zeros((3, 3)), Grid(), math.nan)
    assert raw[:4] == b"II*\0"


def product(folder, scene, centre, lines=400, bins=50, near=800_000, step=60.0):
    """A leader and an image file with the fields that are read, and records between them that are passed over."""
    summary = bytearray(b" " * 1200)

    def put(record, place, text):
        record[place : place + len(text)] = text.encode()

    put(summary, 20, scene)
    put(summary, 60, centre)
    put(summary, 100, "6378.1370000    6356.7523141")
    for place, text in ((495, " 0.2424525"), (704, "    25.0"), (736, "  30.6894840"), (923, "  2000000.0")):
        put(summary, place, text)
    orbit = bytearray(b" " * 4000)
    middle = int(centre[8:10]) * 3600 + int(centre[10:12]) * 60 + int(centre[12:14])
    put(orbit, 149, f"{(middle - 5 * step) % 86400:22.8f}")
    put(orbit, 171, f"{step:22.8f}")
    place = 374
    for k in range(11):
        angle = (k - 5) * step * 7500 / 7.0e6
        state = (7.0e6 * math.cos(angle), 0.0, 7.0e6 * math.sin(angle), -7500 * math.sin(angle), 0.0, 7500 * math.cos(angle))
        for v in state:
            put(orbit, place, f"{v:22.13E}".replace("E", "D"))
            place += 22
    record = lambda n, body: struct.pack(">III", n, 0, len(body) + 12) + bytes(body)
    (folder / f"LED-{scene}-FBDR1.1__A").write_bytes(record(1, b"x" * 700) + record(2, summary) + record(3, orbit) + record(4, b"y" * 5000))
    line = struct.pack(">III", 2, 0, 544 + bins * 8)
    prefix = bytearray(544)
    struct.pack_into(">i", prefix, 104, near)
    body = line + bytes(prefix[: 544 - 12]) + b"\0" * (bins * 8)
    (folder / f"IMG-HH-{scene}-FBDR1.1__A").write_bytes(b"d" * 720 + (line + bytes(prefix) + b"\0" * (bins * 8))[: len(body)] * lines)
    (folder / f"IMG-HH-{scene}-FBDR1.1__A.PRM").write_bytes(b"derived")


def test_scenes_from_their_files(spark, tmp_path):
    product(tmp_path, "ALOS2012345678-180101", "20180102030405500")
    product(tmp_path, "ALOS2012345679-180102", "20180102000010000")  # its orbit record starts on the day before
    got = {r.scene_id: r for r in scenes(spark, str(tmp_path)).collect()}
    a = got["ALOS2012345678-180101"]
    assert (a.wavelength, a.sample_rate, a.prf, a.lines, a.bins, a.near_range) == (0.2424525, 25e6, 2000.0, 400, 50, 800_000.0)
    assert a.duration == 0.2 and str(a.start) == "2018-01-02 03:04:05.400000" and str(a.end) == "2018-01-02 03:04:05.600000"
    assert math.isclose(a.pulse, 30.689484e-6) and a.equatorial_radius == 6378137.0
    assert math.isclose(a.far_range, 800_000 + 50 * 299_792_458 / 5e7)
    assert [s.t for s in got["ALOS2012345679-180102"].states] == [-300.0 + 60 * k for k in range(11)]
    only = leaders(spark, str(tmp_path), ["scene_id", "prf"])
    assert only.columns == ["file", "scene_id", "prf"] and {r.prf for r in only.collect()} == {2000.0}
    assert images(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="no field"):
        leaders(spark, str(tmp_path), ["colour"]).collect()
    ring = {r.scene_id: r.ring for r in scene_footprints(scenes(spark, str(tmp_path))).collect()}["ALOS2012345678-180101"]
    assert len(ring) == 11 and ring[0] == ring[-1]
    # the satellite stands over (0, 0) at the centre and flies north, so a right look sees the east
    assert all(1 < p.lon < 6 and abs(p.lat) < 0.05 for p in ring)
    assert ring[0].lat < ring[4].lat and math.isclose(ring[4].lat - ring[0].lat, math.degrees(0.2 * 7500 / 7.0e6), rel_tol=0.02)


def test_endpoint_files_in_sql(spark, tmp_path):
    for name, paths, year in (("a", 2, 24), ("b", 1, 98)):
        head = ["  1 1", "  GDAS 24 1 1 0 0", f" {paths} BACKWARD OMEGA", *(["24 1 1 0 100.0 0.0 500"] * paths), "1 PRESSURE"]
        body = [f" {k + 1} 1 {year} 1 2 {h} 0 0 -{h}.0 {-1.5 - h} {101.5 + k} 500.0 990.0" for h in range(3) for k in range(paths)]
        (tmp_path / f"{name}.txt").write_text("\n".join(head + body) + "\n")
    register_tables(spark)
    register_lines(spark, str(tmp_path), "endpoint_lines")
    got = spark.sql("SELECT right(file, 5) AS f, direction, traj_id, at, lon, lat FROM endpoint_rows(TABLE(endpoint_lines) PARTITION BY file ORDER BY k) ORDER BY f, traj_id, at").collect()
    assert [tuple(r) for r in got[:2]] == [("a.txt", "BACKWARD", 1, "2024-01-02 00:00:00", 101.5, -1.5), ("a.txt", "BACKWARD", 1, "2024-01-02 01:00:00", 101.5, -2.5)]
    assert len(got) == 9 and {r.at[:4] for r in got if r.f == "b.txt"} == {"1998"}
    (tmp_path / "c.txt").write_text("1 1\nGDAS\n1 FORWARD\nstart\n1 PRESSURE\n1 2 3\n")
    register_lines(spark, str(tmp_path), "endpoint_lines")
    with pytest.raises(Exception, match="fewer than 12 fields"):
        spark.sql("SELECT * FROM endpoint_rows(TABLE(endpoint_lines) PARTITION BY file ORDER BY k)").collect()


def test_slip_models(spark, tmp_path):
    import json

    def feature(strike, dip, slip, flip=False):
        """A patch of 10 by 8 km at 110 E, 0 N, its corners in either order along the strike."""
        along = (10 * math.sin(math.radians(strike)), 10 * math.cos(math.radians(strike)))
        down = tuple(8 * math.cos(math.radians(dip)) * f(math.radians(strike + 90)) for f in (math.sin, math.cos))
        drop = 8000 * math.sin(math.radians(dip))
        place = lambda a, b, z: [110 + (a[0] * b[0] + down[0] * b[1]) / 111.32, (a[1] * b[0] + down[1] * b[1]) / 110.57, z]
        corners = [place(along, (0, 0), 5000.0), place(along, (1, 0), 5000.0), place(along, (1, 1), 5000.0 + drop), place(along, (0, 1), 5000.0 + drop)]
        if flip:
            corners = [corners[1], corners[0], corners[3], corners[2]]
        return {"type": "Feature", "properties": {"slip": slip, "rake": 90.0}, "geometry": {"type": "Polygon", "coordinates": [corners + corners[:1]]}}

    model = {"features": [feature(30.0, 40.0, 1.5), feature(30.0, 40.0, 1.5, flip=True), feature(200.0, 10.0, 0.0), feature(250.0, 70.0, 0.2)]}
    (tmp_path / "model.geojson").write_text(json.dumps(model))
    got = {r.feature: r for r in subfaults(spark, str(tmp_path / "model.geojson")).collect()}
    assert set(got) == {0, 1, 3}
    for k, strike, dip in ((0, 30.0, 40.0), (1, 30.0, 40.0), (3, 250.0, 70.0)):
        assert math.isclose(got[k].strike, strike, abs_tol=0.05) and math.isclose(got[k].dip, dip, abs_tol=0.05)
        assert math.isclose(got[k].length, 10, abs_tol=0.01) and math.isclose(got[k].width, 8, abs_tol=0.01) and got[k].rake == 90.0
    assert math.isclose(got[0].depth, 5 + 4 * math.sin(math.radians(40)), abs_tol=1e-6)


def test_pairs_and_their_rejects(spark):
    text = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    stats = pair_stats(text("# date bperp dt cov coh", "20200101_20200113  12.5 12 0.9 0.5", "20200113_20200125 -3 12.0 0.2 0.1 x", "short_line 1 2 3", "a_b one 2 3 4", "", "20200101_20200125 1 24 0.8 0.4"))
    one, two = rejects(text("# bad", "20200113_20200125 0.2", "")), rejects(text("20200101_20200125", "20200113_20200125"))
    got = {r.pair: (r.days, r.coherence, r.rejected_by) for r in judged(stats, coverage=one, loops=two).collect()}
    assert got == {"20200101_20200113": (12, 0.5, None), "20200113_20200125": (12, 0.1, "coverage"), "20200101_20200125": (24, 0.4, "loops")}


@pytest.mark.parametrize("kind,order", [("4", ">"), ("5", "<"), ("12", ">"), ("2", "<")])
def test_rasters_with_a_header(spark, tmp_path, kind, order):
    values = np.arange(12.0).reshape(3, 4) + (0.5 if kind in "45" else 0)
    (tmp_path / "coh.img").write_bytes(values.astype(order + ENVI_TYPES[kind]).tobytes())
    (tmp_path / "coh.hdr").write_text(f"ENVI\nsamples = 4\nlines   = 3\nbands = 1\ndata type = {kind}\nbyte order = {int(order == '>')}\n")
    got = {(r.r, r.c): r.value for r in headed_raster(spark, str(tmp_path / "coh.hdr")).collect()}
    assert got == dict(np.ndenumerate(values))
    (tmp_path / "coh.img").write_bytes(b"123")
    with pytest.raises(ValueError, match="has 3 bytes"):
        headed_raster(spark, str(tmp_path / "coh.hdr"))


def test_transects_from_a_file(spark, tmp_path):
    import json

    line = lambda *c: {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "LineString", "coordinates": list(c)}}
    (tmp_path / "t.geojson").write_text(json.dumps({"features": [line([1.0, 1.0], [2.0, 5.0], [4.0, 5.0]), {"geometry": {"type": "Point", "coordinates": [0, 0]}}, line([3.0, 3.0], [3.0, 3.0])]}))
    points = geojson_lines(spark, str(tmp_path / "t.geojson"))
    assert points.count() == 5
    got = [tuple(r) for r in transects_of_lines(points, "feature", "k", "lon", "lat").collect()]
    assert got == [(0, 1.0, 1.0, 0.6, 0.8, 5.0)]
    years = lambda *y: spark.createDataFrame([(v,) for v in y], "y int")
    assert sorted(map(tuple, shifted_epochs(years(1990, 2000, 2010, 2000), "y", years(1989, 1991, 2003, 2010), "y").collect()), key=str) == [(1990, 1989), (2000, None), (2010, 2010)]
