"""Finding repeated windows of long texts with little shuffling; two removal operators share it.

A window is n consecutive symbols (words or bytes). Its anchor is the gram of k symbols within it whose
hash is least, the leftmost if several are. Equal windows have equal anchors at the same place, so all
windows can be dealt out by anchor, and consecutive windows with one anchor travel as one stretch of text.

1. census: every slice of documents sends its distinct anchor hashes, packed, to buckets by hash; a bucket
   tells each slice which of its anchors more than one owner has.
2. stretches: slices send each distinct stretch with such an anchor, with what they know of it (`known`), to
   buckets by anchor. A bucket holds all windows that might be equal, and `solve` judges them by their symbols.
3. verdicts go back to the slices, which apply them to their documents.

An anchor with very many stretches, as a passage with ever new surroundings has, is hot: its stretches are cut into
single windows, which are dealt out by their own content instead, so that no bucket gathers them all.

A slice removes copies before it sends anything, so what thousands of documents share reaches a bucket
once for each slice. Slices and buckets are of bounded size and grow in number with the input; the census, whose rows are hashes
alone, takes an eighth as many buckets. Documents are shuffled once, and this shuffle is read three times. They are dealt out by id and
by their place in the table, so that repeated rows are spread like others; the table must give its rows in the same
order when a task is run again, as files do. A single text of 256 MiB or more is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, mixed, powers, slices, window_hashes

_PLACE = np.uint64((1 << 28) - 1)
_NONE = np.int64((1 << 63) - 1).tobytes()
_ODD = np.uint64(0xB492B66FBE98F273)
_ODD_INVERSE = np.uint64(pow(0xB492B66FBE98F273, -1, 1 << 64))


@dataclass
class Runs:
    """Stretches of one piece of a slice: of which text each is, its first window's start, its number of windows, its
    anchor's distance from the start and hash, and its bytes as [begin, stop) of `raw`."""

    raw: bytes
    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    left: np.ndarray
    hash: np.ndarray
    begin: np.ndarray
    stop: np.ndarray

    def contents(self, at: np.ndarray) -> list[bytes]:
        raw = self.raw
        return [raw[a:b] for a, b in zip(self.begin[at].tolist(), self.stop[at].tolist())]


def stretches(grams: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """starts: of all windows, ascending. grams: hash of the gram at each symbol; a window holds `width` of them.
    Start, windows, anchor distance and anchor hash of each stretch."""
    if len(grams) >= 1 << 28:
        raise ValueError(f"a text of {len(grams)} symbols is too long: places are kept in 28 bits")
    if not len(starts):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    m = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    had = 1
    while had * 2 <= width:
        m = np.minimum(m[:-had], m[had:])
        had *= 2
    if had < width:
        m = np.minimum(m[: len(m) - (width - had)], m[width - had :])
    anchor = (m[starts] & _PLACE).astype(np.int64)
    new = np.append(True, (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1]))
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(starts)))
    return starts[first], windows, anchor[first] - starts[first], grams[anchor[first]]


def _starts(first: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of n symbols within texts; the text of each."""
    count = np.maximum(size - n + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    return np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[text], text


@dataclass(frozen=True)
class Words:
    """Windows of words; texts are taken with one space between words."""

    window: int = 13
    gram: int = 5
    piece: int = 1 << 20

    def normal(self, text: bytes) -> bytes:
        return b" ".join(text.split())

    def split(self, content: bytes) -> list[bytes]:
        """The windows of a stretch."""
        words = content.split(b" ")
        return [b" ".join(words[k : k + self.window]) for k in range(len(words) - self.window + 1)]

    def combined(self, verdicts: list[bytes | None]) -> bytes:
        """A stretch's verdict from those of its windows: the least id for each, the largest integer for none."""
        return b"".join(v or _NONE for v in verdicts)

    def runs(self, texts: list[bytes]) -> Runs:
        t = Texts(texts)
        t.words()
        starts, text = _starts(t.first_word, t.n_words, self.window)
        start, windows, left, h = stretches(window_hashes(t.word_hashes(), self.gram), starts, self.window - self.gram + 1)
        own = np.searchsorted(t.first_word, start, side="right") - 1 if len(start) else start
        return Runs(t.raw, own, start - t.first_word[own], windows, left, h, t.starts[start], t.stops[start + windows + self.window - 2])


@dataclass(frozen=True)
class Bytes:
    """Windows of bytes."""

    window: int = 200
    gram: int = 32
    piece: int = 1 << 17  # its arrays of eight bytes for each of its own stay in a core's cache

    def normal(self, text: bytes) -> bytes:
        return text

    def split(self, content: bytes) -> list[bytes]:
        return [content[k : k + self.window] for k in range(len(content) - self.window + 1)]

    def combined(self, verdicts: list[bytes | None]) -> bytes:
        """A stretch's verdict from those of its windows: a bit for each."""
        return np.packbits([v is not None for v in verdicts]).tobytes()

    def runs(self, texts: list[bytes]) -> Runs:
        t = Texts(texts)
        n = len(t.buf)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((t.buf.astype(np.uint64) + np.uint64(1)) * powers(_ODD, n), out=sums[1:])
        m = max(0, n - self.gram + 1)
        grams = mixed((sums[self.gram : self.gram + m] - sums[:m]) * powers(_ODD_INVERSE, n)[:m])
        starts, _ = _starts(t.begins, t.lengths, self.window)
        start, windows, left, h = stretches(grams, starts, self.window - self.gram + 1)
        own = np.searchsorted(t.begins, start, side="right") - 1 if len(start) else start
        return Runs(t.raw, own, start - t.begins[own], windows, left, h, start, start + windows + self.window - 1)


Kind = Words | Bytes
#: Slices that one task takes, at most.
TASK_SLICES = 8


def pieces(kind: Kind, ids: pa.ChunkedArray, texts: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, list[bytes], Runs]]:
    """ids (null: the largest), normalised texts and stretches of a slice, piece by piece."""
    doc = ids.fill_null((1 << 63) - 1).to_numpy()
    normal = [kind.normal(x) for x in texts.to_pylist()]
    for a, b in slices([len(x) for x in normal], kind.piece):
        yield doc[a:b], normal[a:b], kind.runs(normal[a:b])


def _packed(order: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets with the rows of `order` in each; bucket: of each row in that order, ascending."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for a, b in zip(first, np.append(first[1:], len(bucket)) if len(bucket) else []):
        yield int(bucket[a]), order[a:b]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _summed(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of h, whether each has more than one owner, and its count."""
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    if not len(first):
        return h, np.empty(0, bool), np.empty(0, np.uint32)
    count = np.diff(np.append(first, len(h)))
    return h[first], np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first), count.astype(np.uint32)


_CENSUS = "bucket int, slice int, hashes binary, several binary, counts binary"


def _census(kind: Kind, buckets: int, owners: Callable):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found, owner, seen = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for doc, _, runs in pieces(kind, table.column("doc_id"), table.column("text")):
            found.append(runs.hash)
            owner.append(owners(doc, runs, seen))
            seen += len(runs.hash)
        h, several, counts = _summed(np.concatenate(found), np.concatenate(owner))
        bucket = _bucket(h, buckets)
        order = np.argsort(bucket, kind="stable")
        rows = list(_packed(order, bucket[order]))
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in rows], pa.int32()),
                "slice": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "hashes": pa.array([h[x].tobytes() for _, x in rows], pa.binary()),
                "several": pa.array([np.packbits(several[x]).tobytes() for _, x in rows], pa.binary()),
                "counts": pa.array([counts[x].tobytes() for _, x in rows], pa.binary()),
            }
        )

    return run


_REPEATED = "slice int, hashes binary, hot binary"


def _bits(packed: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(packed, sizes)] or [np.empty(0, np.uint8)]).astype(bool)


def _repeated(most: int):
    """Which anchors of each slice are worth sending, and which of these have over `most` stretches."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        several = _bits(table.column("several").to_pylist(), list(map(len, hashes)))
        _, place, slices_ = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        total = np.bincount(place, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32))
        known, hot = several | (slices_[place] > 1), total[place] > most
        at, out = 0, []
        for x in hashes:
            own = known[at : at + len(x)]
            out.append((x[own].tobytes(), np.packbits(hot[at : at + len(x)][own]).tobytes()))
            at += len(x)
        return pa.table({"slice": table.column("slice").combine_chunks(), "hashes": pa.array([x for x, _ in out], pa.binary()), "hot": pa.array([x for _, x in out], pa.binary())})

    return run


def _told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A slice's anchors worth sending, ascending, and whether each is hot."""
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    hot = _bits(table.column("hot").to_pylist(), list(map(len, hashes)))
    h = np.concatenate([np.empty(0, np.uint64), *hashes])
    order = np.argsort(h)
    return h[order], hot[order]


def _places(hashes: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `hashes` has one of told (ascending), and its place there."""
    if not len(told):
        return (np.empty(0, np.int64),) * 2
    place = np.minimum(np.searchsorted(told, hashes), len(told) - 1)
    at = np.flatnonzero(told[place] == hashes)
    return at, place[at]


def digest(content: bytes) -> bytes:
    return xxhash.xxh3_128_digest(content)


_STRETCHES = "bucket int, slice int, contents binary, sizes binary, known binary"


def _send(kind: Kind, buckets: int, learn: Callable, fields: int):
    """learn(doc, runs, at): `fields` integers of each stretch `at`, joined to those of an equal stretch."""

    def run(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
        wanted, hot = _told(right)
        met: dict[bytes, list[int]] = {}
        home: list[int] = []

        def meet(x: bytes, bucket: int, known: list[int]) -> None:
            have = met.get(x)
            if have is None:
                met[x] = known
                home.append(bucket)
            else:
                kind_join(have, known)

        for doc, _, runs in pieces(kind, table.column("doc_id"), table.column("text")):
            at, place = _places(runs.hash, wanted)
            warm = hot[place]
            bucket = _bucket(runs.hash[at], buckets).tolist()
            for x, b, known, cut in zip(runs.contents(at), bucket, learn(doc, runs, at), warm.tolist()):
                if cut:
                    for k, window in enumerate(kind.split(x)):
                        meet(window, int.from_bytes(digest(window)[:7], "little") % buckets, _single(kind, known, k))
                else:
                    meet(x, b, known)
        contents, known = list(met), np.array(list(met.values()), np.int64).reshape(-1, fields)
        bucket = np.array(home, np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = list(_packed(order, bucket[order]))
        packed = [[contents[k] for k in x.tolist()] for _, x in rows]
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in rows], pa.int32()),
                "slice": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "contents": pa.array([b"".join(x) for x in packed], pa.binary()),
                "sizes": pa.array([np.array([len(c) for c in x], np.int32).tobytes() for x in packed], pa.binary()),
                "known": pa.array([known[x].tobytes() for _, x in rows], pa.binary()),
            }
        )

    kind_join = _JOIN[type(kind)]
    return run


def _single(kind: Kind, known: list[int], k: int) -> list[int]:
    """What is known of window k of a stretch."""
    return list(known) if isinstance(kind, Words) else [known[0] - k, 1, known[2]]


def _join_words(have: list[int], known: list[int]) -> None:
    have[0], have[1] = min(have[0], known[0]), max(have[1], known[1])


def _join_bytes(have: list[int], known: list[int]) -> None:
    have[2] += known[2]


_JOIN = {Words: _join_words, Bytes: _join_bytes}

_VERDICTS = "slice int, digests binary, sizes binary, verdicts binary, hot binary"


def _judge(solve: Callable, fields: int):
    """solve(contents, known) -> a verdict (bytes, None for nothing to do) for each content."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        contents, owner = [], []
        for row, (blob, sizes) in enumerate(zip(table.column("contents").to_pylist(), table.column("sizes").to_pylist())):
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
            contents += [blob[a:b] for a, b in zip([0, *ends], ends)]
            owner += [row] * len(ends)
        known = np.frombuffer(b"".join(table.column("known").to_pylist()), np.int64).reshape(-1, fields)
        out: list[list] = [[] for _ in range(table.num_rows)]
        for content, row, verdict in zip(contents, owner, solve(contents, known)):
            if verdict is not None:
                out[row].append((digest(content), verdict))
        return pa.table(
            {
                "slice": table.column("slice").combine_chunks(),
                "digests": pa.array([b"".join(d for d, _ in x) for x in out], pa.binary()),
                "sizes": pa.array([np.array([len(v) for _, v in x], np.int32).tobytes() for x in out], pa.binary()),
                "verdicts": pa.array([b"".join(v for _, v in x) for x in out], pa.binary()),
                "hot": pa.array([b""] * len(out), pa.binary()),
            }
        )

    return run


def verdicts_of(table: pa.Table) -> dict[bytes, bytes]:
    found: dict[bytes, bytes] = {}
    for d, s, v in zip(*(table.column(c).to_pylist() for c in ("digests", "sizes", "verdicts"))):
        ends = np.cumsum(np.frombuffer(s, np.int32)).tolist()
        found.update((d[16 * k : 16 * k + 16], v[a:b]) for k, (a, b) in enumerate(zip([0, *ends], ends)))
    return found


def run_verdicts(kind: Kind, runs: Runs, verdict: dict[bytes, bytes], sent: np.ndarray, hot: np.ndarray) -> list[bytes | None]:
    """The verdict of each stretch; those of hot anchors are put together from their windows'. sent: anchors whose stretches were sent, ascending; the others have none."""
    found: list[bytes | None] = [None] * len(runs.hash)
    if not verdict:
        return found
    at, place = _places(runs.hash, sent)
    for k, content, cut in zip(at.tolist(), runs.contents(at), hot[place].tolist()):
        if cut:
            windows = list(map(verdict.get, map(digest, kind.split(content))))
            found[k] = kind.combined(windows) if any(v is not None for v in windows) else None
        else:
            found[k] = verdict.get(digest(content))
    return found


def judged(docs: DataFrame, kind: Kind, owners: Callable, learn: Callable, fields: int, solve: Callable, apply: Callable, schema: str, slice_bytes: int, hot: int) -> DataFrame:
    """apply(ids, ids as numbers, texts, runs, verdicts) -> a table of `schema` for each piece, over all documents.
    hot: stretches of one anchor, from which on they are cut into windows."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // slice_bytes))
    place = F.monotonically_increasing_id()
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", place), F.lit(n)).cast("int").alias("slice"), "doc_id", text.alias("text"))
    if n > TASK_SLICES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # more tasks than the session would use
        dealt = dealt.repartition(-(-n // TASK_SLICES), "slice")
    by_slice = dealt.groupBy("slice")
    census = by_slice.applyInArrow(_census(kind, max(1, n // 8), owners), _CENSUS)
    repeated = census.groupBy("bucket").applyInArrow(_repeated(hot), _REPEATED)
    sent = by_slice.cogroup(repeated.groupBy("slice")).applyInArrow(_send(kind, n, learn, fields), _STRETCHES)
    verdicts = sent.groupBy("bucket").applyInArrow(_judge(solve, fields), _VERDICTS)
    none = F.lit(b"")
    told = repeated.select("slice", F.col("hashes").alias("digests"), none.alias("sizes"), none.alias("verdicts"), "hot")

    def finish(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
        anchors = pa.compute.greater(pa.compute.binary_length(right.column("hot")), 0)
        sent, cut = _told(right.filter(anchors).select(["digests", "hot"]).rename_columns(["hashes", "hot"]))
        verdict, out, at = verdicts_of(right.filter(pa.compute.invert(anchors))), [], 0
        for doc, texts, runs in pieces(kind, table.column("doc_id"), table.column("text")):
            found = run_verdicts(kind, runs, verdict, sent, cut)
            out.append(apply(table.column("doc_id").slice(at, len(doc)), doc, texts, runs, found))
            at += len(doc)
        return pa.concat_tables(out) if out else None

    return by_slice.cogroup(verdicts.unionByName(told).groupBy("slice")).applyInArrow(finish, schema)
