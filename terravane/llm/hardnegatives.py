"""Hard-negative mining by norm-bucketed search.

For each anchor: its positives (the first rows of its label by inner product), and for each positive the first rows of
other labels whose score lies within a window under the positive's. Candidates are sorted by norm, longest first, and packed
into buckets of some thousand rows; by Cauchy and Schwarz no row of a bucket scores over |anchor| times the bucket's
longest norm. Buckets are searched in waves of growing share, longest first. Between waves the best rows so far give
each anchor its running kth score, so that a wave reads only buckets whose length bound reaches some anchor's limit, and an
anchor meets only buckets whose bound reaches its own: the running kth score, and for negatives the least lower limit
of its windows that aren't filled by better rows.

Anchors are a stated set of queries, taken in blocks: a block is packed into one row of at most `block` anchors, whose size is
therefore bounded, and broadcast to the tasks that hold buckets. A task keeps the best rows of each anchor of the
block, and a shuffle by anchor merges at most k rows of each task. Nothing is keyed by label or norm, so a label or a vector
that a third of all rows share makes no task large, and sorting ties by row splits equal norms over buckets.

Products are exact: float64 where the norms prove every partial sum below 2**53, else int64.

Defined results: see vectors.py; rows with a null label take no part. Order is by score, then vec_id (null last), then row. A row is never
its own positive, but a repeated row is a row of its own, and so is its anchor. A negative positive score has an empty
window. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written
from .vectors import matrix, whole_vectors

#: Rows of a bucket, and anchors whose scores with a bucket are held at once.
BUCKET, AT_ONCE = 4096, 256
#: Shares of the buckets, longest norms first, that the first waves search; the last one searches all others.
WAVES = (1 / 64, 1 / 8)
#: Stands for "no such score yet" and for a null id, which comes last.
LOW, LAST = -(1 << 62), (1 << 63) - 1

_PACKED = "top long, n int, ids binary, labels binary, rows binary, vectors binary"


def _packed(width: int, size: int):
    """Consecutive rows of a task packed into rows of at most `size`, with the greatest square of a norm."""

    def pack(ids, labels, rows, squares, v):
        for a in range(0, len(ids), size):
            s = slice(a, a + size)
            values = [int(squares[s].max()), len(ids[s]), *(np.ascontiguousarray(x[s]).tobytes() for x in (ids, labels, rows, v))]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.int32(), *[pa.binary()] * 4))], ["top", "n", "ids", "labels", "rows", "vectors"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy()
            held.append((ids, batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(4), width)))
            n += batch.num_rows
            if n >= size:
                whole = [np.concatenate(x) for x in zip(*held)]
                full = n - n % size
                yield from pack(*(x[:full] for x in whole))
                held, n = [tuple(x[full:] for x in whole)], n - full
        if n:
            yield from pack(*(np.concatenate(x) for x in zip(*held)))

    return run


class Block:
    """A packed row: ids, labels, rows and vectors of some rows."""

    def __init__(self, row, width: int):
        self.top = row["top"]
        self.ids, self.labels, self.rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "rows"))
        self.v = np.frombuffer(row["vectors"], np.int64).reshape(-1, width)

    def reals(self) -> np.ndarray:
        if not hasattr(self, "_reals"):
            self._reals = self.v.astype(np.float64)
        return self._reals


def products(a: Block, some: np.ndarray, c: Block) -> np.ndarray:
    """Inner products of anchors `some` of a with all rows of c."""
    if float(a.top) * float(c.top) < 2.0**104:  # |x||y| < 2**52 bounds every partial sum
        return (a.reals()[some] @ c.reals().T).astype(np.int64)
    return a.v[some] @ c.v.T


def first_k(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group by score, then id, then row."""
    order = np.lexsort((row, vec_id, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < k]


class Best:
    """The best k rows of each slot that a task has met; slots are windows of anchors. score and vec_id give the kth row of
    earlier waves (LOW: fewer than k), below which nothing counts."""

    def __init__(self, score: np.ndarray, vec_id: np.ndarray, k: int):
        self.k, self.kth, self.kth_id = k, score.copy(), vec_id.copy()
        self.score = np.full((len(score), k), LOW)
        self.vec_id, self.row = np.full((len(score), k), LAST), np.full((len(score), k), LAST)

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        u = np.unique(slot)
        mine = [np.concatenate((x, y.reshape(-1))) for x, y in ((slot, np.repeat(u, self.k)), (score, self.score[u]), (vec_id, self.vec_id[u]), (row, self.row[u]))]
        keep = first_k(*mine, self.k).reshape(-1, self.k)
        self.score[u], self.vec_id[u], self.row[u] = (x[keep] for x in mine[1:])
        last, last_id = self.score[u, -1], self.vec_id[u, -1]
        better = (last > self.kth[u]) | (last == self.kth[u]) & (last_id < self.kth_id[u])
        self.kth[u], self.kth_id[u] = np.where(better, last, self.kth[u]), np.where(better, last_id, self.kth_id[u])

    def rows(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.score > LOW)
        columns = slot, *(x[slot, place] for x in (self.score, self.vec_id, self.row))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["slot", "score", "vec_id", "found"])


class Search:
    """What a wave looks for on behalf of a block of anchors. low and high: (anchors, windows), the scores that count;
    same: rows of the anchor's label, or of others; kth and kth_id: by slot, the kth row of earlier waves."""

    def __init__(self, anchors: Block, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.anchors, self.low, self.high, self.same, self.k = anchors, low, high, same, k
        self.length = np.sqrt((anchors.v.astype(np.float64) ** 2).sum(1))
        self.kth, self.kth_id = np.full(low.size, LOW), np.full(low.size, LAST)

    def limits(self, kth: np.ndarray) -> np.ndarray:
        """The least score that can still count, for each anchor; empty windows ask for none."""
        limit = np.maximum(self.low, kth.reshape(self.low.shape)).astype(np.float64)
        return np.where(self.low <= self.high, limit, np.inf).min(1)

    def reach(self) -> float:
        """The least square of a norm that a bucket needs to matter to any anchor."""
        limit = self.limits(self.kth)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(limit <= 0, 0, limit / self.length) * (1 - 1e-9)
        return float(need.min() ** 2)

    def meet(self, bucket: Block, best: Best) -> None:
        bound = self.length * np.sqrt(float(bucket.top)) * (1 + 1e-9)
        active = np.flatnonzero(bound >= self.limits(best.kth))
        windows = self.low.shape[1]
        for a in range(0, len(active), AT_ONCE):
            some = active[a : a + AT_ONCE]
            score = products(self.anchors, some, bucket)
            alike = self.anchors.labels[some, None] == bucket.labels[None, :]
            fit = alike & (self.anchors.rows[some, None] != bucket.rows[None, :]) if self.same else ~alike
            found = []
            for w in range(windows):
                slots = some * windows + w
                floor = np.maximum(self.low[some, w], best.kth[slots])
                i, j = np.nonzero(fit & (score >= floor[:, None]) & (score <= self.high[some, w][:, None]))
                s, ids = score[i, j], bucket.ids[j]
                counts = (s > best.kth[slots[i]]) | (ids <= best.kth_id[slots[i]])
                found.append((slots[i[counts]], s[counts], ids[counts], bucket.rows[j[counts]]))
            best.add(*(np.concatenate(x) for x in zip(*found)))


_HIT = "slot long, score long, vec_id long, found long"


def _searched(shared, width: int):
    def run(batches):
        search: Search = shared.value
        best = Best(search.kth, search.kth_id, search.k)
        for batch in batches:
            for row in batch.to_pylist():
                search.meet(Block(row, width), best)
        yield best.rows()

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The first k rows of each slot, with their rank from 1."""
    first = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id", "found")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _best(search: Search, buckets: DataFrame, tops: list[int], width: int) -> DataFrame:
    """slot, score, vec_id, found and rank of the first k rows of each slot over all buckets, wave by wave; a written table. Only
    the kth rows come to the driver, one for each slot of the block at most."""
    context, best = buckets.sparkSession.sparkContext, None
    for upper, lower in zip([None, *tops], [*tops, None]):
        reach = search.reach()
        if best is not None and reach == np.inf:
            break
        wave = buckets.where(F.col("top") >= int(min(reach, LAST)))
        if upper is not None:
            wave = wave.where(F.col("top") < upper)
        if lower is not None:
            wave = wave.where(F.col("top") >= lower)
        shared = context.broadcast(search)
        hits = wave.mapInArrow(_searched(shared, width), _HIT)
        best = written(_ranked(hits if best is None else hits.unionByName(best.drop("rank")), search.k))
        if lower is not None:
            kth = best.where(F.col("rank") == search.k).select("slot", "score", "vec_id").toArrow()
            slot = kth["slot"].to_numpy()
            search.kth[slot], search.kth_id[slot] = kth["score"].to_numpy(), kth["vec_id"].to_numpy()
        shared.destroy()
    return best


def mined_negatives(
    rows: DataFrame, scale: int = 256, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, anchor: str = "vec_id % 100 = 0", block: int = 16_384, bucket: int = BUCKET
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for a table with vec_id, embedding and
    label (a whole number).

    anchor: which rows are queries. least, most: bounds of 100 * negative_score / positive_score, inclusive. block: anchors
    broadcast at once; bucket: rows of a bucket.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("label").isNotNull()).select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    vectors, width = whole_vectors(rows, scale, most=1 << 56)  # 100 * score stays within 64 bits
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
    vectors = vectors.select("vec_id", "label", "row", square.alias("square"), "vector")
    out, schema = shared_folder(spark), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    chosen = vectors.where(anchor)
    n = chosen.count()
    if not n:
        return spark.read.schema(schema).parquet(out)
    blocks = written(chosen.repartition(-(-n // block)).mapInArrow(_packed(width, block), _PACKED).withColumn("block", F.monotonically_increasing_id()))
    # equal norms are told apart by row, so that a norm which many rows share is split over tasks
    sorted_rows = vectors.repartitionByRange(F.desc("square"), "row").sortWithinPartitions(F.desc("square"), "row")
    buckets = written(sorted_rows.mapInArrow(_packed(width, bucket), _PACKED))
    found = buckets.agg(F.percentile_approx("top", [1 - w for w in WAVES], 1000).alias("tops"), F.min("top").alias("least")).first()
    tops = sorted({t for t in found.tops if t > found.least}, reverse=True)
    for b in [r.block for r in blocks.select("block").collect()]:  # numbers alone; a block itself has at most `block` rows
        anchors = Block(blocks.where(F.col("block") == b).first(), width)
        size = len(anchors.ids)
        whole = np.full((size, 1), LOW)
        near = _best(Search(anchors, whole, -whole, True, positives), buckets, tops, width)
        scores = near.select("slot", "rank", "score").toArrow()  # `positives` whole numbers for each anchor of the block
        at = scores["slot"].to_numpy(), scores["rank"].to_numpy() - 1
        high, low = np.full((size, positives), LOW), np.full((size, positives), -LOW)
        high[at] = scores["score"].to_numpy() * most // 100
        low[at] = -(-scores["score"].to_numpy() * least // 100)
        far = _best(Search(anchors, low, high, False, negatives), buckets, tops, width)
        ids = spark.createDataFrame(pa.table([pa.array(np.arange(size)), pa.array(anchors.ids)], ["_anchor", "anchor_id"]))  # `block` rows at most
        near = near.select((F.col("slot") * positives + F.col("rank") - 1).alias("slot"), F.col("slot").alias("_anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        far = far.select("slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        rows = near.join(F.broadcast(ids), "_anchor").join(far, "slot")
        null = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
        rows.select(null("anchor_id"), null("positive_id"), "rank", null("negative_id"), "positive_score", "negative_score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
