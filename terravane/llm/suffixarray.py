"""Substring dedup by bytes with a hash-compared suffix sort.

Removes every byte covered by a 200-byte string that also starts anywhere else. Stretches of text that may hold
such strings meet in buckets by their common anchor (see repeats.py). There the suffixes from the
anchors on are sorted, and so are the prefixes before them read backwards. Two suffixes are compared by
a binary search for their common extension over prefix polynomial hashes, which takes a logarithmic
number of steps, and by the symbol after it; a mergesort uses these comparisons. Every pair of neighbours is then
verified by its bytes; should a hash have collided, the order is sorted again by the bytes themselves.

A window reaches l bytes before its anchor. Two stretches hold the same window there if they agree on l bytes
before the anchor and 200 - l from it on, that is if no smaller common extension lies between them in
either order; so classes of equal windows are runs of both orders at once, for each l.

Defined results: a null text is empty; a text of fewer than 200 bytes loses none; copies remove each
other; matches never cross documents. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import powers
from .repeats import Bytes, Runs, judged

_BASE = np.uint64(0xD1342543DE82EF95)


class Extensions:
    """Prefix hashes of a buffer: H[i+1] = H[i] * base + byte, so that a stretch's hash is H[b] - H[a] * base**(b - a)."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.buf = buf
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(inverse, n + 1)[1:], out=sums[1:])
        self.power = powers(_BASE, n + 1)
        self.prefix = sums * self.power

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = self.power[n]
        return self.prefix[a + n] - self.prefix[a] * p == self.prefix[b + n] - self.prefix[b] * p

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to `most`, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether suffix a of length na sorts strictly before suffix b of length nb."""
        most = np.minimum(na, nb)
        n = self.common(a, b, most)
        end = n == most
        last = len(self.buf) - 1
        less = self.buf[np.minimum(a + n, last)] < self.buf[np.minimum(b + n, last)]
        return np.where(end, na < nb, less)


def merge_sorted(ext: Extensions, start: np.ndarray, size: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """Order of the suffixes: a bottom-up mergesort. All runs of a level are merged together: each
    suffix finds its rank in the other run of its pair by binary search. groups: sizes of groups of consecutive suffixes, each
    sorted apart where it stands."""
    n = len(start)
    groups = np.array([n]) if groups is None else groups
    at, begin = np.arange(n), np.repeat(np.cumsum(groups) - groups, groups)
    stop = begin + np.repeat(groups, groups)
    order, width = at, 1
    while width < groups.max():
        pair = begin + (at - begin) // (2 * width) * (2 * width)
        right = at - pair >= width
        low = np.where(right, pair, np.minimum(pair + width, stop))
        high = np.where(right, np.minimum(pair + width, stop), np.minimum(pair + 2 * width, stop))
        base = low.copy()
        own, live = order, np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            mine, other = own[live], own[middle]
            # a suffix of the left run goes before its equals in the right run
            lo_hi = right[live]
            first, second = np.where(lo_hi, mine, other), np.where(lo_hi, other, mine)
            less = ext.before(start[first], size[first], start[second], size[second])
            past = np.where(lo_hi, ~less, less)
            low[live] = np.where(past, middle + 1, low[live])
            high[live] = np.where(past, high[live], middle)
            live = live[low[live] < high[live]]
        rank = at - np.where(right, pair + width, pair) + (low - base) + pair
        merged = np.empty(n, np.int64)
        merged[rank] = own
        order, width = merged, 2 * width
    return order


def suffix_order(raw: bytes, start: np.ndarray, size: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes of raw, and each one's common extension with the one before it (0 for the first of a group), verified by bytes."""
    ext = Extensions(np.frombuffer(raw, np.uint8))
    groups = np.array([len(start)]) if groups is None else groups
    order, inner = merge_sorted(ext, start, size, groups), np.ones(len(start), bool)
    inner[np.cumsum(groups) - groups] = False
    later = np.flatnonzero(inner)
    a, b = order[later - 1], order[later]
    most = np.minimum(size[a], size[b])
    common, same = np.zeros(len(start), np.int64), ext.common(start[a], start[b], most)
    common[later] = same
    for x, nx, y, ny, n in zip(start[a].tolist(), size[a].tolist(), start[b].tolist(), size[b].tolist(), same.tolist()):
        if raw[x : x + n] != raw[y : y + n] or not (nx == n or ny > n and raw[x + n] < raw[y + n]):
            break
    else:
        return order, common
    suffix = [raw[x : x + n] for x, n in zip(start.tolist(), size.tolist())]
    group = np.repeat(np.arange(len(groups)), groups).tolist()
    order = np.array(sorted(range(len(start)), key=lambda k: (group[k], suffix[k])), np.int64)
    for k in later.tolist():
        p, q = suffix[order[k - 1]], suffix[order[k]]
        common[k] = next((k for k, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))
    return order, common


def repeated_windows(contents: list[bytes], left: np.ndarray, windows: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Whether window k of each stretch occurs twice or more. left: the anchor's distance from the stretch's start,
    windows: its number of windows, count: how often the stretch occurs. Shape: stretches by windows. Stretches that follow each other with one
    gram at their anchors are sorted as a group; those of others share no window."""
    n, width = len(contents), int(windows.max())
    size = np.fromiter(map(len, contents), np.int64, n)
    begin = np.cumsum(size) - size
    raw = b"".join(contents)
    grams = [x[a : a + GRAM] for x, a in zip(contents, left.tolist())]
    groups = np.diff([0, *(k for k in range(1, n) if grams[k] != grams[k - 1]), n])
    forth, common_forth = suffix_order(raw, begin + left, size - left, groups)
    back, common_back = suffix_order(raw[::-1], len(raw) - begin - left, left, groups)
    found = np.repeat((count > 1)[:, None], width, axis=1)
    once, least = left - windows + 1, left
    for reach in range(int(once.min()), int(least.max()) + 1):
        has = (once <= reach) & (reach <= least)
        ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
        ahead[forth] = np.cumsum(common_forth < window - reach)
        behind[back] = np.cumsum(common_back < reach)
        at = np.flatnonzero(has)
        key = ahead[at] * (n + 1) + behind[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        total = np.add.reduceat(count[at[order]], np.flatnonzero(new)) if len(at) else np.empty(0, np.int64)
        several = at[order[(total > 1)[np.cumsum(new) - 1]]] if len(at) else at
        found[several, left[several] - reach] = True
    return found


def _solve(window: int):
    def solve(contents: list[bytes], known: np.ndarray) -> list[bytes | None]:
        if not contents:
            return []
        # slices that hold one stretch send it each, with an anchor at one place
        seen: dict[bytes, int] = {}
        own = np.fromiter((seen.setdefault(x, len(seen)) for x in contents), np.int64, len(contents))
        first = np.empty(len(seen), np.int64)
        first[own[::-1]] = np.arange(len(own))[::-1]
        total = np.zeros(len(seen), np.int64)
        np.add.at(total, own, known[:, 2])
        verdicts = judge(list(seen), *known[first, :2].T, total)
        return [verdicts[k] for k in own.tolist()]

    def judge(contents: list[bytes], left: np.ndarray, windows: np.ndarray, count: np.ndarray) -> list[bytes | None]:
        out: list[bytes | None] = [None] * len(contents)
        alone, parts = _parts(contents, left)
        for k in alone:  # no other stretch holds one of its windows
            if count[k] > 1:
                out[k] = np.packbits(np.ones(windows[k], bool)).tobytes()
        for part in parts:
            found = repeated_windows([contents[k] for k in part.tolist()], left[part], windows[part], count[part], window)
            for k, row, n in zip(part.tolist(), found, windows[part].tolist()):
                if row[:n].any():
                    out[k] = np.packbits(row[:n]).tobytes()
        return out

    return solve


GRAM = Bytes().gram


def _parts(contents: list[bytes], left: np.ndarray, most: int = 1 << 21) -> tuple[list[int], list[np.ndarray]]:
    """Stretches that are alone with the gram at their anchor; the others in parts of about `most` bytes, those with
    equal grams together. A part's hashes take some fifty bytes for each of its own."""
    grams: dict[bytes, list[int]] = {}
    for k, (x, a) in enumerate(zip(contents, left.tolist())):
        grams.setdefault(x[a : a + GRAM], []).append(k)
    alone, parts, part, size = [], [], [], 0
    for own in grams.values():
        if len(own) == 1:
            alone += own
            continue
        part += own
        size += sum(len(contents[k]) for k in own)
        if size >= most:
            parts.append(np.array(part))
            part, size = [], 0
    return alone, parts + [np.array(part)] if part else parts


def _learn(doc: np.ndarray, runs: Runs, at: np.ndarray):
    return [[a, n, 1] for a, n in zip(runs.left[at].tolist(), runs.windows[at].tolist())]


def _owners(doc: np.ndarray, runs: Runs, seen: int) -> np.ndarray:
    return np.arange(seen, seen + len(runs.hash))


def _apply(kind: Bytes, keep_text: bool):
    def apply(ids, doc, texts, runs, found) -> pa.Table:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size + 1) - size - 1
        at = np.array([k for k, v in enumerate(found) if v is not None], np.int64)
        bits = np.unpackbits(np.frombuffer(b"".join(found[k] for k in at.tolist()), np.uint8))
        n = runs.windows[at]
        whole = (n + 7) // 8 * 8  # each verdict fills its last byte
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = bits[np.repeat(np.cumsum(whole) - whole, n) + inside] > 0
        places = (np.repeat(runs.begin[at], n) + inside)[hit]
        size_all = len(runs.raw) + 1
        change = np.bincount(places, minlength=size_all) - np.bincount(places + kind.window, minlength=size_all)
        gone = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(gone[1:] & ~gone[:-1]) + 1
        if len(gone) and gone[0]:
            edges = np.append(0, edges)
        spans = np.bincount(np.searchsorted(begin, edges, side="right") - 1, minlength=len(texts))
        sums = np.concatenate(([0], np.cumsum(gone)))
        removed = sums[begin + size] - sums[begin]
        buf = np.frombuffer(runs.raw, np.uint8)
        kept = [x if not r else buf[b : b + n][~gone[b : b + n]].tobytes() for x, r, b, n in zip(texts, removed.tolist(), begin.tolist(), size.tolist())]
        columns = {"doc_id": ids, "n_bytes": pa.array(size), "n_removed": pa.array(removed), "n_spans": pa.array(spans.astype(np.int64))}
        columns["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        if keep_text:
            columns["kept"] = pa.array(kept, pa.binary())
        return pa.table(columns)

    return apply


def repeated_bytes_removed(docs: DataFrame, kind: Bytes = Bytes(), keep_text: bool = False, slice_bytes: int = 8 << 20, hot: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; with keep_text, also the kept bytes."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return judged(docs, kind, _owners, _learn, 3, _solve(kind.window), _apply(kind, keep_text), schema, slice_bytes, hot)
