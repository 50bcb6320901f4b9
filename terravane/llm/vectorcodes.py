"""Vector code compression: each vector becomes a few small codebook indexes.

Components become whole numbers, floor(scale * x), and a vector is cut into equal consecutive parts. Each part position has
a codebook of `entries` entries, first that part of the vectors with the least ids. Each round assigns every part to
the nearest entry of its codebook and moves each entry to the floor of its parts' mean. Codebooks are whole numbers of a
size that parameters bound (parts * entries * width of a part), so they are broadcast; Arrow batches compute all
distances by norm expansion, |x|^2 - 2xc + |c|^2, in exact int64 products, and take the first least one. A task returns
one row of sums for each entry it has used; a shuffle grouped by entry merges those. No key of the data
is ever a shuffle key, so no hot vector or label makes a task large; error sums of labels are joined back by key, which
Spark splits where a label is hot.

Defined results: see vectors.py; with fewer vectors than entries the codebooks have as many entries as vectors; equal ids
are ordered by label and vector, null ids last; an empty table gives no rows; other columns are ignored. A vector
length that `parts` doesn't divide is an error. Errors of a label are summed over equal labels, nulls together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, whole_vectors

#: Vectors of a batch that get their distances at once.
STEP = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equal ones) to each row of x, and the squared distance. All int64."""
    d = x @ book.T
    d *= -2
    d += (book * book).sum(1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at] + (x * x).sum(1)


def _blocks(batch: pa.RecordBatch, at: int, width: int):
    for a in range(0, batch.num_rows, STEP):
        some = batch.slice(a, STEP)
        yield some, matrix(some.column(at), width)


def _sums(shared, width: int):
    """One row for each entry that the task's vectors use: their number and componentwise sum."""

    def run(batches):
        books = shared.value
        parts, entries, own = books.shape
        sums, counts = np.zeros((parts, entries, own), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, v in _blocks(batch, 0, width):
                for p in range(parts):
                    x = np.ascontiguousarray(v[:, p * own : (p + 1) * own])
                    at, _ = nearest(x, books[p])
                    order = np.argsort(at, kind="stable")
                    used, first = np.unique(at[order], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order], first)
                    counts[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * own, pa.int32()), pa.array(sums[p, e].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), lists], ["part", "entry", "n", "sums"])

    return run


def _codes(shared, width: int):
    def run(batches):
        books = shared.value
        parts, _, own = books.shape
        for batch in batches:
            for some, v in _blocks(batch, 2, width):
                found = [nearest(np.ascontiguousarray(v[:, p * own : (p + 1) * own]), books[p]) for p in range(parts)]
                index = np.stack([at for at, _ in found], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * parts, pa.int32()), pa.array(index.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists, pa.array(sum(e for _, e in found))], ["vec_id", "label", "index", "error"])

    return run


def fitted_codebooks(vectors: DataFrame, width: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """Codebooks (parts, entries, width of a part) of a table of whole vectors; see vectors.py."""
    if width % parts:
        raise ValueError(f"vectors of length {width} can't be cut into {parts} equal parts")
    own = width // parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "label", "vector").limit(entries).select("vector").collect()
    books = np.array([r.vector for r in first], np.int64).reshape(-1, parts, own).transpose(1, 0, 2).copy()
    if not len(first):
        return books
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        partial = vectors.select("vector").mapInArrow(_sums(shared, width), "part int, entry int, n long, sums array<long>")
        moved = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(own)))
        books = books.copy()
        for r in moved.collect():  # parts * entries rows at most
            books[r.part, r.entry] = np.array(r[3:], np.int64) // r.n
        shared.destroy()
    return books


def codebooks_text(books: np.ndarray) -> str:
    """All components by part, entry and position within the part."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def coded(vectors: DataFrame, width: int, books: np.ndarray) -> DataFrame:
    """vec_id, label, index (array<int>, an entry for each part) and error (squared distance) of each vector."""
    label = dict(vectors.dtypes)["label"]
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    return vectors.select("vec_id", "label", "vector").mapInArrow(_codes(shared, width), f"vec_id long, label {label}, index array<int>, error long")


def _restored(shared, scale: int):
    def run(batches):
        books = shared.value
        parts, _, own = books.shape
        for batch in batches:
            v = books[np.arange(parts), matrix(batch.column(1), parts)].reshape(batch.num_rows, parts * own)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * (parts * own), pa.int32()), pa.array((v.reshape(-1) + 0.5) / scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["vec_id", "vector"])

    return run


def restored(codes: DataFrame, books: np.ndarray, scale: int = 1024) -> DataFrame:
    """vec_id and vector (array<double>): the middles of the whole-number cells of the entries that `index` names."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    return codes.select("vec_id", "index").mapInArrow(_restored(shared, scale), "vec_id long, vector array<double>")


def vector_codes(rows: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of each row of a table with vec_id,
    embedding and label."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits names 1 to 256 entries")
    vectors, width = whole_vectors(rows, scale)
    books = fitted_codebooks(vectors, width or parts, parts, entries, rounds)
    codes = written(coded(vectors, width or parts, books))
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    code = F.lower(F.array_join(F.transform("index", lambda i: F.lpad(F.hex(i), 2, "0")), ""))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
