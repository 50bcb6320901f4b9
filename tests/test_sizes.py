"""Joins whose work grows with their input: repeated places on both sides, which would give far too many pairs if each copy met each other one."""

from __future__ import annotations

import threading
from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from terravane.operators.coast import crossings
from terravane.operators.joins import nearest


@contextmanager
def within(spark, seconds):
    """Jobs that still run after so many seconds fail."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_repeated_transects_and_strokes_cross_once(spark):
    n = 300_000
    t = spark.range(n).select(F.col("id").alias("t"), F.lit(0.0).alias("x"), (F.col("id") % 2).cast("double").alias("y"), F.lit(1.0).alias("nx"), F.lit(0.0).alias("ny"))
    s = spark.range(n).select((F.col("id") % 3).alias("epoch"), (1.0 + F.col("id") % 3).alias("x1"), F.lit(-0.5).alias("y1"), (1.0 + F.col("id") % 3).alias("x2"), F.lit(0.5).alias("y2"))
    with within(spark, 120):
        got = crossings(t, "t", s, "epoch", 5.0, 2.0).groupBy("epoch", "distance").agg(F.count("*").alias("n"), F.max(F.col("t") % 2).alias("odd")).collect()
    assert sorted(map(tuple, got)) == [(0, 1.0, n // 2, 0), (1, 2.0, n // 2, 0), (2, 3.0, n // 2, 0)]


def test_crossings_keep_the_farthest_of_a_key_and_zeros_of_either_sign(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (1, -0.0, 3.0, 1.0, -0.0), (2, -0.0, 0.0, 1.0, -0.0), (3, None, 0.0, 1.0, 0.0)], "t long, x double, y double, nx double, ny double")
    s = spark.createDataFrame([(0, 1.0, -1.0, 1.0, 1.0), (0, 4.0, 2.0, 4.0, 4.0), (0, 4.0, 2.0, 4.0, 4.0)], "epoch long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, crossings(t, "t", s, "epoch", 5.0, 2.0).collect())) == [(1, 0, 4.0), (2, 0, 1.0)]


def test_repeated_points_and_stops_meet_once(spark):
    n = 400_000
    points = spark.range(n).select("id", F.lit(0.5).alias("x"), (F.col("id") % 2 * 40).cast("double").alias("y"))
    stops = spark.range(n).select((n - F.col("id")).alias("stop"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))
    with within(spark, 120):
        got = nearest(points, stops, ["id"], "x", "y", "sx", "sy", "stop", 1.0).groupBy("y", "stop", "distance").count().collect()
    assert sorted(map(tuple, got), key=str) == [(0.0, 1, 0.5, n // 2), (40.0, None, None, n // 2)]


def test_nearest_in_crowds_by_finer_squares(spark):
    """A dense cluster amid sparse stops: finer squares first, and the same stops as by brute force, ties to the least."""
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random((150, 2)) * 8, 3 + rng.random((150, 2)) / 20, [[7.0, 7.0]]])
    q = np.concatenate([rng.random((40, 2)) * 8, 3 + rng.random((900, 2)) / 20, [[7.0, 7.1], [7.0, 6.9], [7.1, 7.0]]])
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id int, x double, y double")
    stops = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(q)], "stop int, sx double, sy double")
    away = np.round(np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)), 9)
    want = {k: int(row.argmin()) if row.min() <= 1 else None for k, row in enumerate(away)}
    for crowd in (2, 64, 10_000):
        got = {r.id: r.stop for r in nearest(points, stops, ["id"], "x", "y", "sx", "sy", "stop", 1.0, digits=9, crowd=crowd).collect()}
        assert got == want
