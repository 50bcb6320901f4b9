"""Projections against published points, resampling between them, and offsets between images."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions.projection import TransverseMercator, utm, utm_zone
from terravane.operators.warp import fitted_offsets, image_offsets, resampled, shift_of

#: The British national grid, and the worked example of its guide: a point to a millimetre.
BRITAIN = TransverseMercator(lon=-2.0, lat=49.0, scale=0.9996012717, east=400_000.0, north=-100_000.0, axis=6377563.396, flattening=(6377563.396 - 6356256.909) / 6377563.396)
TOWER = (1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600, 651409.903, 313177.270)


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(map(float, values))], "a double, b double")
    return tuple(df.select(*(x.alias(f"v{k}") for k, x in enumerate(f(F.col("a"), F.col("b"))))).first())


def test_a_published_point_to_a_millimetre(spark):
    lon, lat, east, north = TOWER
    x, y = one(spark, BRITAIN.project, lon, lat)
    assert abs(x - east) < 1e-3 and abs(y - north) < 1e-3
    back = one(spark, BRITAIN.place, east, north)
    assert abs(back[0] - lon) * 67_000 < 1e-3 and abs(back[1] - lat) * 111_000 < 1e-3
    x, y = one(spark, utm(38).project, 44.4, 33.3)
    assert abs(x - 444140.54) < 0.006 and abs(y - 3684706.36) < 0.006


def test_the_meridian_and_the_way_back(spark):
    # along the central meridian the northing is the scaled arc of the ellipse, here by numerical integration
    e2 = utm(1).flattening * (2 - utm(1).flattening)
    phi = np.linspace(0, math.radians(60), 200_001)
    m = utm(1).axis * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = ((m[:-1] + m[1:]) / 2 * np.diff(phi)).sum()
    x, y = one(spark, utm(49).project, 111.0, 60.0)
    assert abs(y - 0.9996 * arc) < 1e-3 and abs(x - 500_000) < 1e-6
    places = spark.createDataFrame([(float(lon), float(lat)) for lon in range(100, 123, 2) for lat in range(-80, 81, 16)], "lon double, lat double")
    p = utm(49, south=True)
    x, y = p.project(F.col("lon"), F.col("lat"))
    lon, lat = p.place(F.col("x"), F.col("y"))
    got = places.withColumns({"x": x, "y": y}).select((lon - F.col("lon")).alias("dx"), (lat - F.col("lat")).alias("dy")).agg(F.max(F.abs("dx")), F.max(F.abs("dy"))).first()
    assert max(got) < 1e-9  # a tenth of a millimetre
    assert [r[0] for r in spark.createDataFrame([(-180.0,), (110.3,), (180.0,)], "lon double").select(utm_zone(F.col("lon"))).collect()] == [1, 49, 60]
    with pytest.raises(ValueError):
        utm(61)


def test_grids_of_other_projections(spark):
    p, size = utm(49), 1000.0
    source = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(40) for c in range(40)], "r int, c int, v double")  # UTM cells from (480000, 40000)
    target = spark.createDataFrame([(r, c) for r in range(30) for c in range(30)], "r int, c int")  # 0.012 degrees

    def to_place(c, r):
        return F.lit(110.83) + c * 0.012, F.lit(0.37) + r * 0.012

    def from_place(lon, lat):
        x, y = p.project(lon, lat)
        return (x - 480_000) / size - 0.5, (y - 40_000) / size - 0.5

    exact = target.select("r", "c", *(x.alias(k) for k, x in zip(("lon", "lat"), to_place(F.col("c"), F.col("r")))))
    at = exact.select("r", "c", *(x.alias(k) for k, x in zip(("x", "y"), from_place(F.col("lon"), F.col("lat"))))).collect()
    want = {(a.r, a.c): 10 * a.y + a.x for a in at if 0 <= a.x <= 39 and 0 <= a.y <= 39}
    got = {(r.r, r.c): r.v for r in resampled(target, source, "v", to_place, from_place, "bilinear").collect()}
    assert len(got) == 900 and len(want) > 500
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items()) and all(v is None for k, v in got.items() if k not in want)
    near = {(r.r, r.c): r.v for r in resampled(target, source, "v", to_place, from_place).collect()}
    assert all(near[a.r, a.c] == 10 * math.floor(a.y + 0.5) + math.floor(a.x + 0.5) for a in at if (a.r, a.c) in want)


def speckle(size, seed=3):
    """Smooth random texture as a function of real positions."""
    rng = np.random.default_rng(seed)
    waves = rng.normal(0, 0.55, (400, 2)), rng.uniform(0, 2 * np.pi, 400)
    return lambda y, x: 30 + sum(np.cos(y * a + x * b + p) for (a, b), p in zip(*waves))


def test_shifts_are_found_to_a_tenth_of_a_pixel(spark):
    f = speckle(256)
    y, x = np.mgrid[:64, :64].astype(float)
    for dy, dx in ((0.0, 0.0), (3.0, -2.0), (1.5, 0.25), (-4.7, 6.3)):
        got = shift_of(f(y, x), f(y - dy, x - dx))
        assert abs(got[0] - dy) < 0.1 and abs(got[1] - dx) < 0.1
    y, x = np.mgrid[:256, :320].astype(float)
    # the second image is shifted and stretched: content of (y, x) lies at y + dy, x + dx
    dy, dx = 2.0 + 0.004 * y, -1.5 + 0.003 * x
    first, second = f(y, x), f(y - dy, x - dx)
    second[64:128, 64:128] = np.random.default_rng(1).random((64, 64)) * 60  # a patch that has changed
    frame = lambda v: spark.createDataFrame([(r, c, float(z)) for (r, c), z in np.ndenumerate(v)], "r int, c int, amp double")
    offsets = image_offsets(frame(first), frame(second).where("r < 250"), "amp", 64, 32)
    planes = fitted_offsets(offsets)
    for name, values in (("dy", dy), ("dx", dx)):
        a, by, bx = planes[name]
        model = a + by * y + bx * x
        assert np.abs(model - values)[32:-32, 32:-32].max() < 0.1, name
    assert image_offsets(frame(first[:64, :64]), frame(np.zeros((64, 64))), "amp", 64).collect() == []
    with pytest.raises(ValueError, match="too few"):
        fitted_offsets(offsets.limit(3))
