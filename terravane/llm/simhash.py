"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in 3 bits at most,
some segment starts a chain whose cumulative differences stay within the proportional budgets: 0 bits
in the first segment, 1 in the first two, 2 in the first three, 3 in all. Candidates share a start
segment and all but one bit of the next one, which is the first half of the chain and the shuffle key;
the rest of the chain is checked next, and the full Hamming distance last.

Equal fingerprints are one node, so copies cost nothing. Within a key, tasks return a spanning forest
of the links they find, not all pairs; keys with more than `most` fingerprints are dealt out as pairs of blocks.

Defined results: a text without words, empty or null, has fingerprint zero and links like any other;
fewer than three words make one shingle; a null doc_id gets its component's id, null if it has no other
member; rows are linked by their fingerprints alone, also where they repeat a doc_id. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import parts, shared_folder, written

SEED = 42
_LANES = np.uint64(0x0001000100010001)


def _majorities(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text, the bits set in over half of its hashes. Bits are counted four at a time in 16-bit lanes."""
    pieces = np.concatenate([np.arange(a, a + k, 65535) for a, k in zip(first, n) if k] or [np.empty(0, np.int64)])
    out = np.zeros(len(n), np.uint64)
    if not len(pieces):
        return out
    text = np.searchsorted(first, pieces, side="right") - 1
    half = n // 2
    for k in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, pieces)
        for lane in range(4):
            count = np.zeros(len(n), np.int64)
            np.add.at(count, text, ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
            out |= (count > half).astype(np.uint64) << np.uint64(k + 16 * lane)
    return out


def simhashes(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()
        line = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        if len(words) > shingle:
            starts = np.concatenate(([0], stops[:-shingle] + 1)).tolist()
            own = [digest(line[a:b], SEED) for a, b in zip(starts, stops[shingle - 1 :].tolist())]
        else:
            own = [digest(line, SEED)] if words else []
        hashes.append(np.array(own, np.uint64))
        sizes.append(len(own))
    n = np.array(sizes, np.int64)
    return _majorities(np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.cumsum(n) - n, n)


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, 1, 1 << 20):
                found = simhashes(part.column(1).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each text as a signed 64-bit integer."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", text.alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _chain(start: np.ndarray, bit: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """Whether pairs that share a key pass the whole chain from their start segment; pairs equal in both
    first segments share all keys of that start, and pass for bit 0 alone."""
    of = [np.bitwise_count((diff >> (np.uint64(16) * ((start + np.uint64(k)) % np.uint64(4)))) & np.uint64(0xFFFF)) for k in range(4)]
    two = of[0] + of[1]
    three = two + of[2]
    return (of[0] == 0) & (two <= 1) & ((of[1] == 1) | (bit == 0)) & (three <= 2) & (three + of[3] <= 3)


def _forest(key: int, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the fingerprints under one key connect."""
    start, bit = np.uint64(key >> 36), np.uint64(key >> 32 & 15)
    left, a, b = np.ones(len(fp), bool), [], []
    while left.any():
        reach = [int(np.flatnonzero(left)[0])]
        left[reach[0]] = False
        while reach:
            at = reach.pop()
            rest = np.flatnonzero(left)
            near = rest[_chain(start, bit, fp[at] ^ fp[rest])]
            left[near] = False
            a += [rep[at]] * len(near)
            b += rep[near].tolist()
            reach += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _links(most: int):
    """Rows (key, fp, rep) sorted by key -> (over, a, b): links (false, rep, rep) or, for a key with over
    `most` rows, (true, key, fp) and its block and rep."""
    few = 6

    def rows(a, b, key=None, block=None):
        n = len(a)
        over = key is not None
        columns = [pa.array(np.full(n, over)), pa.array(a), pa.array(b), pa.array(np.full(n, key if over else 0, np.int64)), pa.array(np.full(n, block if over else 0, np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["over", "a", "b", "key", "block"])

    def one(key, fp, rep, block):
        if block or len(fp) > most:
            yield rows(fp.view(np.int64), rep, key, block)
        elif len(fp) > 1:
            yield rows(*_forest(key, fp, rep))

    def run(batches):
        key, fp, rep, block = None, [], [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            reps = batch.column(2).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            stops = np.append(firsts[1:], len(keys))
            inner = (stops - firsts > 1) & (stops - firsts <= few)
            inner[[0, -1]] = False  # the first and last key may have more rows in another batch
            for lag in range(1, few):
                at = np.concatenate([firsts[inner & (stops - firsts > lag)] + k for k in range(few - lag)])
                end = np.concatenate([stops[inner & (stops - firsts > lag)]] * (few - lag))
                at = at[at + lag < end]
                k = keys[at].astype(np.uint64)
                good = at[_chain(k >> np.uint64(36), k >> np.uint64(32) & np.uint64(15), fps[at] ^ fps[at + lag])]
                if len(good):
                    yield rows(reps[good], reps[good + lag])
            for i in np.flatnonzero((stops - firsts > few) | ~(inner | (stops - firsts == 1)) | np.isin(np.arange(len(firsts)), (0, len(firsts) - 1))).tolist():
                a, b = firsts[i], stops[i]
                if keys[a] != key:
                    if fp:
                        yield from one(key, np.concatenate(fp), np.concatenate(rep), block)
                    key, fp, rep, block = int(keys[a]), [], [], 0
                fp.append(fps[a:b])
                rep.append(reps[a:b])
                while sum(map(len, fp)) > most:
                    f, r = np.concatenate(fp), np.concatenate(rep)
                    yield rows(f[:most].view(np.int64), r[:most], key, block)
                    fp, rep, block = [f[most:]], [r[most:]], block + 1
        if fp:
            yield from one(key, np.concatenate(fp), np.concatenate(rep), block)

    return run


_LINKS = "over boolean, a long, b long, key long, block long"


def _pairs(batches):
    """Rows (key, pair, fp, rep) sorted by key and pair -> links between what each pair of blocks holds."""
    now, fp, rep = None, [], []

    def done():
        a, b = _forest(now[0], np.array(fp, np.int64).view(np.uint64), np.array(rep, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    for batch in batches:
        for k, p, f, r in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, p) != now:
                if fp:
                    yield done()
                now, fp, rep = (k, p), [], []
            fp.append(f)
            rep.append(r)
    if fp:
        yield done()


def near_links(nodes: DataFrame, most: int = 2048) -> DataFrame:
    """Links (u, v) between the names `rep` of nodes (fp, rep) that connect all fingerprints within 3 bits of each other."""
    shift = "shiftrightunsigned(fp, 16 * {}) & 65535L"
    keys = f"""explode(transform(sequence(0, 63), x -> shiftleft(cast(x as bigint), 32)
        | shiftleft({shift.format("(x div 16)")}, 16)
        | ({shift.format("((x div 16 + 1) % 4)")} & ~shiftleft(1L, x % 16)))) AS key"""
    # each node gives 64 rows, so the nodes are spread over all tasks first, however few bytes they are
    spread = nodes.where("rep IS NOT NULL").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    keyed = spread.selectExpr(keys.replace("(x div 16)", "int(x div 16)").replace("((x div 16 + 1) % 4)", "int((x div 16 + 1) % 4)"), "fp", "rep")
    found = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(most), _LINKS)
    found = written(found, shared_folder(nodes.sparkSession))
    links = found.where("NOT over").select(F.col("a").alias("u"), F.col("b").alias("v"))
    over = found.where("over").select("key", "block", F.col("a").alias("fp"), F.col("b").alias("rep"))
    if not over.isEmpty():
        last = over.groupBy("key").agg(F.max("block").alias("last"))
        dealt = over.join(last, "key").selectExpr("key", "explode(transform(sequence(0L, last), y -> least(block, y) * (last + 1) + greatest(block, y))) AS pair", "fp", "rep")
        links = links.union(dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_pairs, "u long, v long"))
    return links


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (the least doc_id reachable) of each document."""
    spark = docs.sparkSession
    prints = written(fingerprints(docs, shingle), shared_folder(spark))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(near_links(nodes.select("fp", F.col("fp").alias("rep"))))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, shared_folder(spark))
    least = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), shared_folder(spark))
    named = rooted.join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", digits, "component_id")

