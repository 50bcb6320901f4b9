"""BPE encoding and decoding of whole texts, split beforehand at forced boundaries.

A token never spans two bytes that stand side by side inside no token of the vocabulary. Each such
pair of bytes in a normalised text is therefore a certain cut, as is each border between the words
that the tokenizer's own pattern separates. Fragments between cuts are encoded independently, each
distinct one once while it stays in a bounded cache, and their ids are concatenated.

Cuts need rules known for each character, so a run between white space that holds "<|" (special strings), white space
beyond ASCII, or a character whose class isn't settled (beyond U+FFFF, or classed otherwise by Unicode 3.2)
goes to the library whole; such runs are certain cuts as well, because no token holds white space.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty
string; repeated rows are encoded alike; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, Texts, parts

#: Fragments kept by each Python worker; beyond that the cache starts anew.
CACHED = 200_000
#: Marks, at the end of a cache key, a fragment that ends inside a word. No UTF-8 text holds this byte.
INSIDE = b"\xff"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted: bytes that
    print as themselves in Latin-1, then the others in order as U+0100, U+0101 and so on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class WordBpe:
    """A word-ending BPE tokenizer file, with the tables that forced-boundary splitting needs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        suffix, letters = spec["model"]["end_of_word_suffix"], byte_letters()
        self.inside_pairs = np.zeros((256, 256), bool)
        for token in spec["model"]["vocab"]:
            word = [letters[c] for c in token.removesuffix(suffix)]
            self.inside_pairs[word[:-1], word[1:]] = True
        # the same merges for a fragment that doesn't end its word: nothing marks its end
        spec["model"]["end_of_word_suffix"] = None
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec["normalizer"] = None
        spec["added_tokens"] = []
        self.inside = Tokenizer.from_str(json.dumps(spec))
        n = self.whole.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.whole.id_to_token(i) or "" for i in range(n)]
        old = unicodedata.ucd_3_2_0
        self.kinds = np.full(0x10001, 4, np.uint8)  # 0 white space, 1 letter, 2 number, 3 other, 4 not settled
        for c in range(0x10000):
            kind = unicodedata.category(chr(c))[0]
            if c < 0x240 or old.category(chr(c))[0] == kind and old.category(chr(c)) != "Cn":
                self.kinds[c] = 0 if chr(c).isspace() and not 0x1C <= c <= 0x1F else {"L": 1, "N": 2}.get(kind, 3)
        self.cache: dict[bytes, bytes] = {}

    def fragments(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Cache keys of the fragments of normalised texts; the first fragment of each text, and the end."""
        t = Texts(texts)
        b = t.buf
        lead = (b & 0xC0) != 0x80
        after, third = np.append(b[1:], 32), np.append(b[2:], [32, 32])[: len(b)]
        wide, low = b.astype(np.uint32), (after & 0x3F).astype(np.uint32)
        code = np.where(b < 0x80, wide, (wide & 0x1F) << 6 | low)
        code = np.where(b >= 0xE0, (wide & 0x0F) << 12 | low << 6 | (third & 0x3F), code)
        code = np.where(b >= 0xF0, 0x10000, code)
        kind = self.kinds[np.where(lead, code, 0x21)]
        at = np.maximum.accumulate(np.where(lead, np.arange(len(b)), 0))
        kind = kind[at]
        space = _IS_SPACE[b]
        odd = (kind == 4) | ((b == 0x3C) & (after == 0x7C)) | ((kind == 0) & ~space)
        previous, kind_before = np.append(np.uint8(32), b[:-1]), np.append(np.uint8(0), kind[:-1])
        edge = (kind != kind_before) | (kind == 2)
        # an apostrophe that no other punctuation stands before is one piece with the contraction after it, and what follows is another
        mark = np.flatnonzero((b == 0x27) & (kind_before != 3))
        single = np.isin(after[mark], np.frombuffer(b"stmd", np.uint8))
        double = np.isin(after[mark].astype(np.uint16) << 8 | third[mark], [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
        edge[mark[single | double] + 1] = False
        edge[mark[single] + 2] = True
        edge[mark[double] + 3] = True
        cut = lead & (edge | ~self.inside_pairs[previous, b])
        run = np.cumsum(space)  # of bytes between white space
        if odd.any():
            whole = np.zeros(run[-1] + 1, bool)
            whole[run[odd]] = True
            whole = whole[run] & ~space
            before = np.append(True, space[:-1])
            cut = np.where(whole, before, cut)
        else:
            whole = None
        cut |= space | np.append(True, space[:-1])
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(b))
        real = ~space[starts]
        starts, stops = starts[real], stops[real]
        raw = t.raw
        keys = [raw[s:e] for s, e in zip(starts.tolist(), stops.tolist())]
        follows = stops < len(b)
        nxt = np.where(follows, stops, 0)
        inner = follows & ~edge[nxt] & ~space[nxt]
        if whole is not None:
            inner &= ~whole[starts]
        for i in np.flatnonzero(inner).tolist():
            keys[i] += INSIDE
        return keys, np.append(np.searchsorted(starts, t.begins), len(starts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        normal, raw = [], []
        for x in texts:
            y = unicodedata.normalize("NFC", x)
            y = (y.replace("Σ", "σ") if "Σ" in y else y).lower().encode()
            normal.append(y)
            raw.append(x)
        keys, first = self.fragments(normal)
        self.restore(keys, first, normal, raw)
        ids = list(map(self.cache.get, keys))
        if None in ids:
            missing = list({k for k, v in zip(keys, ids) if v is None})
            if len(self.cache) + len(missing) > CACHED:
                self.cache.clear()
                missing = list(set(keys))
            self.learn(missing)
            ids = list(map(self.cache.__getitem__, keys))
        first = first.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(first, first[1:])]

    def restore(self, keys: list[bytes], first: np.ndarray, normal: list[bytes], raw: list[str]) -> None:
        """Special strings are matched in the text as it was, so a run with "<|" gets its own letters back."""
        for k, text in enumerate(normal):
            if b"<|" in text:
                runs = iter(x for x in raw[k].encode().split() if b"<|" in x)
                for i in range(first[k], first[k + 1]):
                    if b"<|" in keys[i]:
                        keys[i] = next(runs)

    def learn(self, missing: list[bytes]) -> None:
        plain = [k for k in missing if k[-1:] != INSIDE]
        inner = [k for k in missing if k[-1:] == INSIDE]
        for model, some, cut in ((self.whole, plain, None), (self.inside, inner, -1)):
            for a in range(0, len(some), 20_000):
                part = some[a : a + 20_000]
                found = model.encode_batch_fast([k[:cut].decode() for k in part], add_special_tokens=False)
                for k, e in zip(part, found):
                    self.cache[k] = np.array(e.ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """As the library does for a file without a decoder: tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordBpe(path)


def _encode(path: str, slice_bytes: int, keep: tuple[str, ...]):
    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for part in parts(batch, 1, slice_bytes):
                encoded = bpe.encode(part.column(1).to_pylist())
                decoded = [bpe.decode(x) for x in encoded]
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if "ids" in keep:
                    columns.append(pa.array([np.frombuffer(x, "<i4") for x in encoded], pa.list_(pa.int32())))
                    names.append("ids")
                if "decoded" in keep:
                    columns.append(pa.array(decoded, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = (), slice_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each document. keep: which of ids
    and decoded (the text) to return as well. path: the tokenizer's file, on every executor."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encode(path, slice_bytes, keep), schema)
