"""Every registered query of the engine's own operators against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from terravane.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def forest(columns, rows, duck):
    """Each row of the test part is predicted once, and its labels are what the split gives."""
    at = {c: k for k, c in enumerate(columns)}
    got = {}
    for r in rows:
        got[r[at["label"]]] = got.get(r[at["label"]], 0) + r[at["n"]]
    want = duck.execute("SELECT label::double, count(*) FROM embeddings WHERE (vec_id * 7919 + 42) % 100 >= 70 GROUP BY 1").fetchall()
    assert got == dict(want)


def paths(columns, rows, duck):
    """Every parcel is followed over all steps of six hours."""
    at = {c: k for k, c in enumerate(columns)}
    steps = {}
    for r in rows:
        steps.setdefault(r[at["traj_id"]], set()).add(r[at["k"]])
    assert all(x == set(range(19)) for x in steps.values())


WITHOUT_TWIN = {"ch29_random_forest": forest, "rc3_parcels": paths}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        WITHOUT_TWIN[name](columns, rows, duck)
        return
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert len(rows) == len(expected)
    for got, want in zip(rows, expected):
        for a, b in zip(got, want):
            assert a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6), (got, want)
