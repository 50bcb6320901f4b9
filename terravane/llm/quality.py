"""Quality rules: length and repetition rules, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte n-grams: one counted on trusted target
texts, one on the whole raw corpus. A document's score is the sum of log(p_target / p_raw) over
its n-grams divided by their number, in nats; every document whose score is below the threshold
is rejected, without randomness. Weights are integers (2**-20 nats), so sums don't depend on the
order or batching of rows.

Defined results: a null text has no words and fails the base rules; a document with no n-gram
scores 0; with no trusted text at all, or an empty corpus, each weight is 0 and the ratio rejects
nothing. Repeated rows are judged alike, each on its own. Extra columns are kept by `kept_documents`
and ignored by `quality_report`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, parts, window_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCALE = 1 << 20


@dataclass(frozen=True)
class QualityRules:
    """min_words, window, max_repeat_percent: the base rules. buckets: size of the multinomials, which
    bounds what is gathered and broadcast (two longs a bucket). gram: bytes in an n-gram.
    target_rows: at most so many trusted documents, those with the smallest hashes of their ids, make
    the target; the raw corpus is counted whole. smoothing: pseudo-count of each bucket.
    threshold: least score, in nats for an n-gram, of a kept document."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    buckets: int = 1 << 16
    gram: int = 4
    target_rows: int = 20_000
    smoothing: float = 1.0
    threshold: float = -0.5
    slice_bytes: int = 1 << 18


def _buckets(t: Texts, rules: QualityRules) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram at each byte of the buffer; whether one lies within one text there."""
    n, g = len(t.buf), rules.gram
    h = np.zeros(n, np.uint64)
    for k in range(g):
        h[: n - k] |= t.buf[k:].astype(np.uint64) << np.uint64(8 * k)
    h *= np.uint64(0x9E3779B97F4A7C15)
    bits = rules.buckets.bit_length() - 1
    whole = np.ones(n, bool)
    for k in range(g):  # the last g-1 bytes of a text and its space start none
        at = t.ends - 1 - k
        whole[at[at >= t.begins]] = False
    return (h >> np.uint64(64 - bits)).astype(np.int64), whole


def _count(rules: QualityRules):
    def run(batches):
        raw = np.zeros(rules.buckets, np.int64)
        target = np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for part in parts(batch, 0, rules.slice_bytes):
                t, trusted = Texts(part.column(0).to_pylist()), np.array(part.column(1).to_pylist(), bool)
                bucket, whole = _buckets(t, rules)
                raw += np.bincount(bucket[whole], minlength=rules.buckets)
                if trusted.any():
                    whole &= np.repeat(trusted, t.lengths + 1)
                    target += np.bincount(bucket[whole], minlength=rules.buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    return run


def _texts(docs: DataFrame):
    return F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")


def ngram_weights(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> np.ndarray:
    """Integer weight of each bucket: log(p_target / p_raw) times 2**20.

    Each task counts into `buckets` counters before anything is shuffled, so a hot source costs
    nothing more, and the driver gathers `buckets` rows whatever the input's size.
    """
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.target_rows).withColumn("trusted", F.lit(True))
    marked = docs.select("doc_id", _texts(docs)).join(F.broadcast(trusted), "doc_id", "left")
    counts = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(_count(rules), "bucket int, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(rules.buckets), np.zeros(rules.buckets)
    raw[rows.bucket], target[rows.bucket] = rows.raw, rows.target
    if not target.sum():
        return np.zeros(rules.buckets, np.int64)
    p_raw = (raw + rules.smoothing) / (raw.sum() + rules.smoothing * rules.buckets)
    p_target = (target + rules.smoothing) / (target.sum() + rules.smoothing * rules.buckets)
    return np.rint(np.log(p_target / p_raw) * _SCALE).astype(np.int64)


def repeated_window_words(t: Texts, n: int) -> np.ndarray:
    """Whether each word is in a window of n words found twice or more in its text. Windows with equal
    hashes are compared word by word before they count as equal."""
    words = t.word_hashes()
    covered = np.zeros(len(words) + 1, np.int64)
    h = window_hashes(words, n)
    if len(h):
        text = np.repeat(np.arange(len(t.n_words)), t.n_words)
        at = np.flatnonzero(text[: len(h)] == text[n - 1 :])
        order = at[np.lexsort((h[at], text[at]))] if len(at) else at
        a, b = order[:-1], order[1:]
        same = (h[a] == h[b]) & (text[a] == text[b])
        a, b = a[same], b[same]
        for k in range(n):
            equal = words[a + k] == words[b + k]
            a, b = a[equal], b[equal]
        hit = np.unique(np.concatenate((a, b)))
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + n, -1)
    return np.cumsum(covered)[:-1] > 0


def _measure(rules: QualityRules, weights):
    def run(batches):
        w = weights.value
        for batch in batches:
            for part in parts(batch, 1, rules.slice_bytes):
                texts = part.column(1).to_pylist()
                t = Texts(texts)
                t.words()
                lead = (t.buf & 0xC0) != 0x80
                spaces = t.per_text(np.isin(t.buf, np.frombuffer(b" \t\n\v\f\r", np.uint8)))
                dup_lines = []
                for x in texts:
                    lines = [line for line in x.split(b"\n") if line.strip()]
                    dup_lines.append(len(lines) - len(set(lines)))
                bucket, whole = _buckets(t, rules)
                grams = t.per_text(whole)
                score = t.per_text(np.where(whole, w[bucket], 0))
                repeat = t.per_text_of_words(repeated_window_words(t, rules.window))
                failed = (t.n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * t.n_words)
                kept = ~failed & (score >= math.floor(rules.threshold * _SCALE) * grams)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(t.n_words.astype(np.int64)),
                        pa.array(t.per_text(lead) - spaces),
                        pa.array(t.per_text(_SYMBOL[t.buf])),
                        pa.array(dup_lines, pa.int64()),
                        pa.array(repeat),
                        pa.array(failed),
                        pa.array(kept),
                        pa.array(score / np.maximum(grams, 1) / _SCALE),
                    ],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"],
                )

    return run


def quality_report(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row for each document: its counts, base_failed, the verdict `kept` and the score `llr`."""
    weights = docs.sparkSession.sparkContext.broadcast(ngram_weights(docs, labels, rules))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    return docs.select("doc_id", _texts(docs)).mapInArrow(_measure(rules, weights), schema)


def _filter(rules: QualityRules, weights, at: int):
    measure = _measure(rules, weights)

    def run(batches):
        for batch in batches:
            for part in parts(batch, at, rules.slice_bytes):
                text = pc.fill_null(part.column(at).cast(pa.binary()), b"")
                judged = measure([pa.RecordBatch.from_arrays([pa.array(range(len(text))), text], ["doc_id", "text"])])
                yield part.filter(pa.concat_arrays([x.column("kept") for x in judged] or [pa.array([], pa.bool_())]))

    return run


def kept_documents(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs, with all their columns, that pass the rules."""
    weights = docs.sparkSession.sparkContext.broadcast(ngram_weights(docs, labels, rules))
    return docs.mapInArrow(_filter(rules, weights, docs.columns.index("text")), docs.schema)
