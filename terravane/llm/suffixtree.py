"""Substring dedup by words with prefix-partitioned suffix trees.

Removes every word covered by a window of 13 words whose sequence also starts in a document with a
smaller doc_id. Candidate suffixes, those that start a window whose anchor several documents share
(see repeats.py), meet in buckets. There, variable-length prefixes split them into groups that fit in memory:
by the first word, and a group that is still too large by one word more. Each group's subtree is built top
down, a word a level, following only nodes with two leaves or more; the internal nodes that reach the window's
depth are the repeats, and each passes its least doc_id down to its leaves. Words are compared
themselves, not hashes.

Defined results: a null text has no words; a document of fewer than 13 words loses none; a null doc_id is larger
than any other; rows with the same doc_id don't remove words from each other. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Runs, Words, judged


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int, limit: int, at: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, node) of the nodes at `depth` with two leaves or more. words: a number for each word of all
    texts; starts: of the suffixes, as indices of words; at: words that all of them share; limit: suffixes
    of a group in memory. Suffixes are returned as indices into starts."""
    out = []
    stack = [(np.arange(len(starts)), at)]
    while stack:
        own, at = stack.pop()
        if 0 <= at < depth and len(own) > limit:  # a longer prefix
            word = words[starts[own] + at]
            order = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(word[order]) != 0))
            size = np.diff(np.append(first, len(order)))
            for k in np.flatnonzero(size > limit).tolist():
                stack.append((own[order[first[k] : first[k] + size[k]]], at + 1))
            fits = (size > 1) & (size <= limit)
            rows = order[np.repeat(fits, size)]
            packs = np.cumsum(size[fits]) // limit  # consecutive prefixes, up to twice the limit together
            cuts = np.flatnonzero(np.diff(np.repeat(packs, size[fits]))) + 1
            stack += [(own[x], -1 - at) for x in np.split(rows, cuts) if len(x)]
            continue
        # prefixes that fit share one forest; a negative depth marks a group made of several prefixes
        node = np.zeros(len(own), np.int64)
        at = at if at >= 0 else -1 - at
        while at < depth and len(own):
            key = node * (len(words) + 1) + words[starts[own] + at]
            _, node, leaves = np.unique(key, return_inverse=True, return_counts=True)
            inner = leaves[node] > 1
            own, node = own[inner], node[inner]
            at += 1
        if len(own):
            out.append((own, node))
    return out


def _solve(window: int, limit: int):
    def solve(contents: list[bytes], known: np.ndarray) -> list[bytes | None]:
        numbers: dict[bytes, int] = {}
        words, first = [], [0]
        for x in contents:
            words += [numbers.setdefault(w, len(numbers)) for w in x.split(b" ")]
            first.append(len(words))
        words, first = np.array(words, np.int64), np.array(first, np.int64)
        count = np.diff(first) - window + 1
        content = np.repeat(np.arange(len(contents)), count)
        starts = np.arange(len(content)) - np.repeat(np.cumsum(count) - count, count) + first[content]
        least = known[content, 0].copy()
        for own, node in deep_nodes(words, starts, window, limit):
            low = np.full(node.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, node, least[own])
            least[own] = low[node]
        ends = np.cumsum(count)
        useful = np.logical_or.reduceat(least < known[content, 1], ends - count) if len(content) else []
        return [least[b - n : b].tobytes() if good else None for b, n, good in zip(ends.tolist(), count.tolist(), useful)]

    return solve


def _learn(doc: np.ndarray, runs: Runs, at: np.ndarray):
    return [[x, x] for x in doc[runs.text[at]].tolist()]


def _covered(kind: Words, doc: np.ndarray, texts: list[bytes], runs: Runs, found: list[bytes | None]) -> dict[int, np.ndarray]:
    """For texts that lose words, whether each word stays."""
    out: dict[int, np.ndarray] = {}
    hit = [k for k, v in enumerate(found) if v is not None]
    if not hit:
        return out
    at = np.array(hit)
    least = np.frombuffer(b"".join(found[k] for k in hit), np.int64)
    n = runs.windows[at]
    text = np.repeat(runs.text[at], n)
    start = np.repeat(runs.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    good = least < doc[text]
    text, start = text[good], start[good]
    order = np.argsort(text, kind="stable")
    text, start = text[order], start[order]
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else []
    for a, b in zip(first, np.append(first[1:], len(text)) if len(text) else []):
        size = texts[text[a]].count(b" ") + 1
        change = np.zeros(size + 1, np.int64)
        np.add.at(change, start[a:b], 1)
        np.add.at(change, start[a:b] + kind.window, -1)
        out[int(text[a])] = np.cumsum(change)[:-1] == 0
    return out


def _apply(kind: Words, keep_text: bool):
    def apply(ids, doc, texts, runs, found) -> pa.Table:
        kept = _covered(kind, doc, texts, runs, found)
        n_words, n_removed, out = [], [], []
        for k, x in enumerate(texts):
            n = x.count(b" ") + 1 if x else 0
            stays = kept.get(k)
            n_words.append(n)
            n_removed.append(0 if stays is None else n - int(stays.sum()))
            out.append(x if stays is None else b" ".join(w for w, s in zip(x.split(b" "), stays.tolist()) if s))
        columns = {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        columns["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
        if keep_text:
            columns["kept"] = pa.array([x.decode() for x in out], pa.string())
        return pa.table(columns)

    return apply


def _owners(doc: np.ndarray, runs: Runs, seen: int) -> np.ndarray:
    return doc[runs.text]


def repeated_words_removed(docs: DataFrame, kind: Words = Words(), keep_text: bool = False, slice_bytes: int = 8 << 20, limit: int = 1 << 15, hot: int = 4096) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document; with keep_text, also the kept words."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return judged(docs, kind, _owners, _learn, 2, _solve(kind.window, limit), _apply(kind, keep_text), schema, slice_bytes, hot)
