"""Packing into sequences: pieces against the library, sequences against what they must hold."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from terravane.llm.packing import packed, placed, run_encoder, sequences
from terravane.llm.queries import op13_packing, tokenizer

SCHEMA = "doc_id long, text string, length string, number string"


@pytest.fixture(scope="module")
def path():
    return tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def by_library(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


ODD = [
    None, "", " ", "\n\t \r\x0b\x0c", "a", "The quick brown fox's don't we'll I'D they've 'S ''s '''ve", "x" * 5000, "ab" * 300 + " " + "cd1" * 400, "ΑΣ Σ ΟΔΟΣ", "İstanbul ıI ſ K Å é é ñ ñ",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <| |>", "a\x00b \x1c c\x1dd \x85 e\xa0f g ​h­i", "1234567890 12,5 ½ ² ª º", "日本語のテキスト 中文", "🙂👍🏽 e‍m", "﻿bom �", "ßẞ ǅ ŉ ɐ ȿ Ȿ", "don't'll''re re've", "!!!??? ...&&& --- ___",
]


def test_runs_are_encoded_as_the_library_does(path, library):
    encoder = run_encoder(path)
    assert encoder.by_rank
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéüßñçøæåœšžıİǅ0123456789.,;:!?'\"-_&<|>#@()"
    texts = [t for t in ODD if t is not None]
    texts += [" ".join("".join(rng.choices(letters, weights=[8] * 26 + [1] * (len(letters) - 26), k=rng.randint(1, 14))) for _ in range(60)) for _ in range(150)]
    texts += ["".join(rng.choices(["th", "er", "in", "chen", "'s", "'", "ll", "1", ".", "<|", "|>", " ", "\n", "É", "ing"], k=300)) for _ in range(60)]
    for text in texts:
        assert encoder.encode(text.encode()) == by_library(library, text)[:-1].tobytes(), text[:80]


def test_the_cache_starts_anew_and_long_texts_go_in_stretches(path, library, monkeypatch):
    from terravane.llm import packing

    monkeypatch.setattr(packing, "CACHED", 40)
    monkeypatch.setattr(packing, "STRETCH", 100)
    encoder = packing.RunEncoder(path)
    assert len(encoder) == 0
    text = " ".join(f"word{k % 90} Ünter{k} {'long' * (k % 40)}" for k in range(400))
    assert encoder.encode(text.encode()) == by_library(library, text)[:-1].tobytes()


def check(rows, texts, library, limit):
    """Pieces as stated, sequences within the limit and without gaps. Gives the number of sequences and its least."""
    expected = []
    for doc_id, text in texts:
        ids = by_library(library, text)
        for k, a in enumerate(range(0, len(ids), limit)):
            own = ids[a : a + limit]
            expected.append((doc_id, k, a, len(own), zlib.crc32(own.tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(held), -(-sum(r[3] for r in expected) // limit)


@pytest.mark.parametrize("limit,group", [(2048, 4096), (64, 16), (7, 3)])
def test_odd_rows(spark, path, library, limit, group):
    texts = list(enumerate(ODD)) + [(3, ODD[5]), (3, ODD[5]), (None, "one two three"), (None, None)]
    docs = spark.createDataFrame([(*t, "x", "y") for t in texts], SCHEMA).repartition(3)
    found = packed(docs, path, limit=limit, group=group)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n, least = check(found.collect(), texts, library, limit)
    assert n <= 1.15 * least + 2
    assert packed(docs.limit(0), path).collect() == []


def test_sequences_hold_the_ids(spark, path, library):
    texts = [(k, f"{'Some words of document' * (k % 5)} {k}. " * (k % 37)) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = packed(docs, path, limit=128, group=50, ids=True).cache()
    check(found.drop("ids").collect(), texts, library, 128)
    whole = {r.sequence_id: r.ids for r in sequences(found).collect()}
    for r in found.collect():
        ids = by_library(library, texts[r.doc_id][1])[r.start : r.start + r.length].tolist()
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids == r.ids


def squares(open_gaps):
    return sum(n * n for n in np.bincount(open_gaps, minlength=1)[1:].tolist())


def test_each_piece_goes_where_the_sum_of_squares_is_least():
    rng = random.Random(2)
    for limit, n in ((20, 120), (50, 200)):
        lengths = sorted((rng.randint(1, limit - 1) for _ in range(n)), reverse=True)
        bins, offsets, left = placed(lengths, limit)
        gaps = []
        for s, b, offset in zip(lengths, bins, offsets):
            room = [g for g in gaps if g >= s]
            if not room:
                assert b == len(gaps) and offset == 0
                gaps.append(limit - s)
                continue
            after = {g: squares([*(x for k, x in enumerate(gaps) if k != gaps.index(g)), g - s]) for g in set(room)}
            assert after[gaps[b]] == min(after.values()) and offset == limit - gaps[b]
            gaps[b] -= s
        assert gaps == left


def test_the_query_packs_all_documents_closely(spark, sf, library):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n, least = check(op13_packing(spark, sf).collect(), texts, library, 2048)
    assert n <= 1.01 * least + 1


def test_many_groups_lose_few_sequences(spark, path, library):
    rng = random.Random(9)
    texts = [(k, "a " * rng.randint(0, 150)) for k in range(3000)]
    n, least = check(packed(spark.createDataFrame(texts, "doc_id long, text string"), path, limit=128, group=100).collect(), texts, library, 128)
    assert n <= 1.03 * least
