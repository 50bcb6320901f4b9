"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder, written

__all__ = ["SPACES", "Texts", "before_buckets", "mixed", "parts", "powers", "shared_folder", "slices", "table", "window_hashes", "written"]

#: The six ASCII white-space bytes that end a word; bytes.split() uses the same six.
SPACES = b" \t\n\v\f\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them; kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows that hold about `most` bytes together (one row at least)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(lengths):
        yield start, len(lengths)


def parts(batch: pa.RecordBatch, at: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in column `at` (one row at least), so that a worker never holds more than
    these as Python objects, however large the batch is."""
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    for a, b in slices(lengths, most):
        yield batch.slice(a, b - a)


def before_buckets(sums: DataFrame, by: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """by, bucket and `name`: the sum of `value` over the earlier buckets of the same `by`. sums: one row a bucket, numbered below
    2**24. Windows are over up to 4,096 buckets each, and over the sums of as many such ranges."""
    high = F.shiftrightunsigned(F.col(bucket), 12)
    same = [f"_by{k}" for k in range(len(by))]
    ranges = sums.groupBy(*(F.col(k).alias(n) for k, n in zip(by, same)), high.alias("_range")).agg(F.sum(value).alias("_all"))
    ranges = ranges.withColumn("_earlier", F.sum("_all").over(Window.partitionBy(*same).orderBy("_range")) - F.col("_all")).drop("_all")
    inner = sums.withColumn("_high", high)
    inner = inner.withColumn("_inner", F.sum(value).over(Window.partitionBy(*by, "_high").orderBy(bucket)) - F.col(value))
    met = F.col("_high") == F.col("_range")
    for k, n in zip(by, same):
        met = met & F.col(k).eqNullSafe(F.col(n))
    return inner.join(ranges, met).select(*by, bucket, (F.col("_earlier") + F.col("_inner")).alias(name))


class Texts:
    """Several texts as one byte buffer, a space after each, with numpy views of their words.

    Words are maximal runs of bytes outside SPACES. No word spans two texts.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts) + b" "
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lengths + 1)  # one past the space that follows each text
        self.begins = self.ends - self.lengths - 1

    def words(self) -> None:
        inside = ~_IS_SPACE[self.buf]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & ~before)
        self.stops = np.flatnonzero(before & ~inside)
        first = np.searchsorted(self.starts, self.begins)
        self.first_word = first
        self.n_words = np.diff(np.append(first, len(self.starts)))

    def word_hashes(self) -> np.ndarray:
        """64-bit polynomial hash of each word's bytes, mixed; equal words have equal hashes anywhere."""
        n = len(self.buf)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        h = (sums[self.stops] - sums[self.starts]) * powers(_BASE_INVERSE, n)[self.starts]
        return mixed(h ^ (self.stops - self.starts).astype(np.uint64))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags (one for each byte of the buffer) within each text, its space included."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.ends] - sums[self.begins]

    def per_text_of_words(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags (one for each word) within each text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.first_word + self.n_words] - sums[self.first_word]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive items of h."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += h[k : k + m]
    return mixed(out)
