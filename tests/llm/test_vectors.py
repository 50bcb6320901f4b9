"""Vector codes and hard negatives against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from terravane.llm import hardnegatives
from terravane.llm.hardnegatives import mined_negatives
from terravane.llm.queries import QUERIES, SQL
from terravane.llm.vectorcodes import codebooks_text, coded, fitted_codebooks, restored, vector_codes
from terravane.llm.vectors import whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def odd_rows(seed=1, n=400, width=8):
    """Random vectors with ties, copies, null labels and ids, and every kind of row that is left out."""
    rng = random.Random(seed)
    vector = lambda: [rng.choice([-1.5, -0.5, 0.0, 0.25, 1.0, 2.0]) if rng.random() < 0.5 else rng.gauss(0, 1) for _ in range(width)]
    common = vector()
    rows = [(k, common if rng.random() < 0.3 else vector(), rng.choice([0, 0, 0, 1, 2, None])) for k in range(n)]
    rows += [rows[100], rows[100], (100, vector(), 1), (None, vector(), 0), (None, common, 1)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * (width - 1) + [None], 1), (903, [math.nan] * width, 1), (904, [math.inf] + [1.0] * (width - 1), 1), (905, [1.0] * (width + 4), 1)]
    rng.shuffle(rows)
    return rows


def kept(rows, scale, width):
    good = [r for r in rows if r[1] and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in good]


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    rows = sorted(kept(rows, 1024, 8), key=lambda r: (r[0] is None, r[0] or 0, r[2] is not None, r[2] or 0, r[1]))
    own = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * own : (p + 1) * own]
    books = [[cut(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in rows:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, xs in groups.items():
                books[p][e] = [sum(x) // len(xs) for x in zip(*xs)]
    out, sums = [], {}
    for i, v, label in rows:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(y) for b in books for c in b for y in c).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_equal_brute_force(spark, entries):
    rows = odd_rows()
    found = vector_codes(frame(spark, rows).repartition(5), entries=entries)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == codes_by_hand(rows, entries=entries)


def test_few_rows_empty_tables_and_bad_lengths(spark):
    few = [(3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], None)] * 2
    assert sorted(map(tuple, vector_codes(frame(spark, few)).collect())) == codes_by_hand(few)
    assert vector_codes(frame(spark, [])).collect() == []
    assert vector_codes(frame(spark, [(1, None, 1)])).collect() == []
    assert mined_negatives(frame(spark, [])).collect() == []
    assert mined_negatives(frame(spark, [(100, [1.0], None), (101, [1.0], 1)])).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(frame(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(Exception, match="sum of squares"):
        vector_codes(frame(spark, [(1, [1e30] * 8, 1)])).collect()


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-2e4, 2e4) for _ in range(8)], k % 3) for k in range(60)]
    assert sorted(map(tuple, vector_codes(frame(spark, rows), entries=7).collect()), key=str) == codes_by_hand(rows, entries=7)
    assert sorted(map(tuple, mined_negatives(frame(spark, rows), anchor="vec_id % 10 = 0").collect()), key=str) == negatives_by_hand(rows, 10)


def test_restored_vectors_have_the_stated_error(spark):
    rows = [r for r in odd_rows(7) if r[0] is not None and r[0] != 100]
    vectors, width = whole_vectors(frame(spark, rows), 1024)
    books = fitted_codebooks(vectors, width, entries=16)
    codes = {r.vec_id: r for r in coded(vectors, width, books).collect()}
    back = {r.vec_id: r.vector for r in restored(coded(vectors, width, books), books).collect()}
    own = {i: v for i, v, _ in kept(rows, 1024, 8)}
    assert back.keys() == own.keys() and codebooks_text(books).count(",") == 4 * 16 * 2 - 1
    for i, v in own.items():
        assert sum((x - math.floor(1024 * y)) ** 2 for x, y in zip(v, back[i])) == codes[i].error


def negatives_by_hand(rows, every=100):
    rows = [r for r in kept(rows, 256, 8) if r[2] is not None]
    last = 1 << 62
    order = lambda s: (-s[0], last if s[1] is None else s[1])
    out = []
    for a, (anchor, v, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, other == label) for k, (i, w, other) in enumerate(rows) if k != a]
        for score, positive, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            window = sorted((s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score), key=order)[:5]
            out += [(anchor, positive, rank + 1, i, score, s) for rank, (s, i, _) in enumerate(window)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,block,bucket", [(1, 16_384, 4096), (2, 2, 16), (3, 3, 7)])
def test_negatives_equal_brute_force(spark, seed, block, bucket):
    rows = odd_rows(seed)
    found = mined_negatives(frame(spark, rows).repartition(6), block=block, bucket=bucket)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = negatives_by_hand(rows)
    assert len(expected) > 50
    assert sorted(map(tuple, found.collect()), key=str) == expected


def test_short_buckets_are_not_met(spark):
    """Norms that fall by steps: the length bound spares most products, and the result stays whole."""
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) * 0.97**k * 50 for _ in range(8)], k % 2) for k in range(300)]
    assert sorted(map(tuple, mined_negatives(frame(spark, rows), bucket=8).collect()), key=str) == negatives_by_hand(rows)
    a = hardnegatives.Block({"top": 0, "ids": np.arange(1).tobytes(), "labels": np.zeros(1, int).tobytes(), "rows": np.arange(1).tobytes(), "vectors": np.full(8, 10).tobytes()}, 8)
    search = hardnegatives.Search(a, np.array([[5000]]), np.array([[9000]]), False, 5)
    assert 31_000 < search.reach() < 31_251  # (5000 / |anchor|) ** 2
    search.kth[0] = 6000
    assert 44_000 < search.reach() < 45_001
    empty = hardnegatives.Search(a, np.array([[1]]), np.array([[0]]), False, 5)
    assert empty.reach() == np.inf


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    expected = con.sql(SQL[name])
    found = QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(expected.columns)
    assert sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(expected.fetchall())
