"""Quantiles and components on awkward inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators.graph import components, distances
from terravane.operators.quantiles import levels, quantiles


@pytest.mark.parametrize("kind", ["outlier", "powers", "ties", "one", "whole"])
def test_no_bin_is_crowded_and_quantiles_stay_exact(spark, kind):
    rng = np.random.default_rng(4)
    values = {
        "outlier": [*rng.random(20_000).tolist(), 1e9],
        "powers": (10.0 ** rng.uniform(-300, 300, 9_000)).tolist(),
        "ties": [0.0] * 5000 + rng.integers(0, 40, 5000).astype(float).tolist(),
        "one": [3.5],
        "whole": rng.integers(-(10**12), 10**12, 6000).tolist(),
    }[kind]
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x long" if kind == "whole" else "x double")
    wanted = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.777, "e": 1.0}
    got = quantiles(df, "x", wanted).first()
    assert got.n == len(values)
    for name, q in wanted.items():
        assert np.isclose(got[name], np.quantile(np.array(values, float), q), rtol=1e-9, atol=1e-12), name
    ranked = {r.x: r._before_n for r in levels(df, "x", n=F.count("*")).collect()}
    order = np.sort(np.array(values))
    assert all(b == np.searchsorted(order, x) for x, b in ranked.items()) and len(ranked) == len(set(values))


def test_bins_follow_the_values(spark):
    from terravane.operators import quantiles as module

    values = [*np.random.default_rng(4).random(20_000).tolist(), 1e9]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    plan = levels(df, "x", n=F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get(_e") < 8 * module.STEPS  # each halving stands on the one before, not on copies of it


def test_few_links_and_many_give_the_same(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (7, 8), (7, 8)]
    df = spark.createDataFrame(links, "u long, v long")
    short, whole = ({r.node: r.root for r in components(df, few=n).collect()} for n in (50_000, 0))
    assert short == whole and short[8] == short[7]
    assert components(df.limit(0)).collect() == []


def test_distances_over_many_rounds(spark):
    n = 40
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(n)] + [(0, n, 30.0)], "src long, dst long, len double")
    for merge in (2, 8, 100):
        got = {r.node: r.dist for r in distances(edges, spark.createDataFrame([(0,)], "node long"), 25.0, merge=merge).collect()}
        assert got == {k: float(k) for k in range(26)}
    assert distances(edges, spark.createDataFrame([], "node long"), 9.0).collect() == []
