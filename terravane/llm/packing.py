"""Best-fit packing of documents into sequences of a token limit, by the sum-of-squares rule.

Each document's ids, and an end id, are one piece; longer documents alone are cut, into pieces of the limit and a rest.
Pieces of exactly the limit are sequences of their own. The others are dealt out by a hash of a number of their own to groups of some
thousand, so neither copies nor lengths that many rows share crowd a group. A group places its pieces longest first: among
the open sequences that have room, where the sum over residual gaps of the squared number of open sequences with that gap becomes
smallest; a new one is opened only where none has room. Sequences that stay short of the limit by `spare` or more are taken apart
again and their pieces are dealt to new groups, while that saves sequences. Texts are read once and never shuffled;
a piece is a few numbers.

A run between white space is encoded on its own, as no token of this kind of vocabulary holds white space; each distinct run once
while it stays in a bounded cache. A word of settled Latin letters, with or without signs after it, is merged by the vocabulary's ranks; any other
run goes to the tokenizers library.

Defined results: a null text counts as empty, and an empty text is one piece that holds the end id alone; repeated rows are packed as rows
of their own; a null doc_id stays null; an empty table gives no rows; other columns are ignored. Which pieces share a sequence
depends on the order of the table's rows; the number of sequences hardly does.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import parts, written

#: Runs kept by each Python worker; bytes of a text that are split at once; longest run that ranks merge.
CACHED, STRETCH, RANKED = 400_000, 1 << 18, 200
#: Ends a word among the ranks; no UTF-8 text holds this byte.
END = b"\xff"
#: Signs that often end a word, none of them part of a contraction.
SIGNS = b".,;:!?"
#: Characters whose classes are settled and that the normaliser gives one lower-case character each.
_SETTLED = re.compile("[a-zA-Z\xa1-\u012f\u0131-\u023f]+")
_SPACE = re.compile(rb"[ \t\n\v\f\r]")


class RunEncoder(dict):
    """Ids of texts by the runs between their white space: a cache of runs (lower case wherever a text has no special string), filled as they are met."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_letters()
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            word = bytes(letters[c] for c in token.removesuffix(suffix))
            return word + END if token.endswith(suffix) else word

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = {(raw(a), raw(b)): k for k, (a, b) in reversed(list(enumerate(pairs)))}

        def merges_to_itself(token: bytes) -> bool:
            """Whether the merges, in their order, make one token of these bytes: others never come about, and where all do, ranks
            of whole tokens give what the list of pairs gives."""
            ended = token.endswith(END)
            s = [token[i : i + 1] for i in range(len(token) - 2 * ended)] + [token[-2:]] * ended
            while len(s) > 1:
                k = min(range(len(s) - 1), key=lambda i: order.get((s[i], s[i + 1]), len(order)))
                if (s[k], s[k + 1]) not in order:
                    return False
                s[k : k + 2] = [s[k] + s[k + 1]]
            return True

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + END: 256 + b for b in range(256)}  # ends are joined before all else
        tokens = {raw(t): i for t, i in model["vocab"].items()}
        ids = [tokens.get(t, 0) for t in ranks]
        for a, b in sorted(order, key=order.get):
            if a + b not in ranks and merges_to_itself(a + b):
                ranks[a + b] = len(ids)
                ids.append(tokens[a + b])
        self.packed = [np.array(i, "<u4").tobytes() for i in ids]
        self.by_rank = len({a + b for a, b in order}) == len(order)  # else two pairs make one token, and its rank is not one number
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.merge = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def word(self, word: bytes) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.merge(word + END)))

    def __missing__(self, run: bytes) -> bytes:
        """The ids of a run: one word, or one with signs after it, by ranks; any other by the library."""
        if len(self) >= CACHED:
            self.clear()
        ids = None
        if self.by_rank and len(run) <= RANKED:
            stem = run.rstrip(SIGNS)
            if stem.islower() and stem.isalpha():  # bytes: ASCII letters
                ids = self.word(stem)
            elif not run.isascii():
                text = stem.decode()
                if _SETTLED.fullmatch(text) and text.isalpha():
                    ids = self.word(text.lower().encode())
            if ids is not None and len(stem) < len(run):
                ids += self.word(run[len(stem) :])  # signs alone are one piece
        if ids is None:
            ids = np.array(self.library.encode(run.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[run] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if b"<|" not in text:  # special strings are matched before letters become small
            text = text.lower()
        out, start = [], 0
        while start < len(text):
            end = len(text)
            if end - start > STRETCH:
                space = _SPACE.search(text, start + STRETCH)
                end = space.start() if space else end
            out.append(b"".join(map(self.__getitem__, text[start:end].split())))
            start = end
        return b"".join(out)


@lru_cache(2)
def run_encoder(path: str) -> RunEncoder:
    return RunEncoder(path)


def _pieces(path: str, limit: int, end_id: int, ids: bool):
    def run(batches):
        encoder, end = run_encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in parts(batch, 1):
                columns: list[list] = [[], [], [], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    whole = encoder.encode(text) + end
                    for k, a in enumerate(range(0, len(whole), 4 * limit)):
                        own = whole[a : a + 4 * limit]
                        for c, x in zip(columns, (doc_id, k, a // 4, len(own) // 4, zlib.crc32(own), own)):
                            c.append(x)
                types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                if ids:
                    arrays.append(pa.array([np.frombuffer(x, "<i4") for x in columns[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return run


def pieces(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, number (a piece's own) and, if asked for, ids (array<int>) of each piece; a written table."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return written(texts.mapInArrow(_pieces(path, limit, end_id, ids), schema).withColumn("number", F.monotonically_increasing_id()))


def placed(lengths: list[int], limit: int) -> tuple[list[int], list[int], list[int]]:
    """Sequence (from 0) and offset of each piece, in the order given, and the gap that each sequence is left with."""
    count, holders = np.zeros(limit + 1, np.int64), [[] for _ in range(limit + 1)]  # open sequences by gap
    bins, offsets, gaps = [], [], []
    never = np.int64(1 << 60)
    for s in lengths:
        room = count[s:]
        # a sequence leaves gap s + k and, unless it is full then, joins gap k
        change = 2 * (count[: limit + 1 - s] - room) + 2
        change[0] = 1 - 2 * room[0]
        change[room == 0] = never
        k = int(change.argmin())
        if room[k]:
            b = holders[s + k].pop()
            count[s + k] -= 1
        else:
            b, k = len(gaps), limit - s
            gaps.append(limit)
        bins.append(b)
        offsets.append(limit - s - k)
        gaps[b] = k
        if k:
            count[k] += 1
            holders[k].append(b)
    return bins, offsets, gaps


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, number long, sequence_id long, offset long, gap int"


def _placed(limit: int, turn: int):
    def run(table: pa.Table) -> pa.Table:
        length, number = table["length"].to_numpy(), table["number"].to_numpy()
        table = table.take(pa.array(np.lexsort((number, -length))))
        bins, offsets, gaps = placed(table["length"].to_pylist(), limit)
        group = table["group"][0].as_py()
        own = np.array(bins, np.int64)
        columns = {"sequence_id": (turn << 56) + (group << 20) + own, "offset": np.array(offsets, np.int64), "gap": np.array(gaps, np.int32)[own]}
        table = table.drop_columns(["group"])
        for name, x in columns.items():
            table = table.append_column(name, pa.array(x))
        return table

    return run


def packed(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, ids: bool = False, group: int = 4096, spare: int = 16, turns: int = 6) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece.

    group: pieces placed by one task at once, on average; spare: the gap from which a sequence is taken apart and packed again,
    turns: how often at most.
    """
    whole = pieces(docs, path, limit, end_id, ids)
    bare = whole.drop("ids")
    full = bare.where(F.col("length") == limit).withColumns({"sequence_id": -1 - F.col("number"), "offset": F.lit(0).cast("long"), "gap": F.lit(0)})
    rest = bare.where(F.col("length") < limit)
    done, held, n = [full], None, rest.count()
    for turn in range(turns):
        if not n:
            break
        groups = -(-n // group)
        dealt = rest.select(*bare.columns, F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(groups)).alias("group"))
        new = written(dealt.groupBy("group").applyInArrow(_placed(limit, turn), _PLACED))
        sizes = new.agg(F.sum((F.col("offset") == 0).cast("long")), F.sum((F.col("gap") >= spare).cast("long"))).first()
        if held is not None and sizes[0] >= held[1]:
            break  # nothing saved: they stay as they were
        if held is not None:
            done.append(held[0].where(F.col("gap") < spare))
        open_ = new.where(F.col("gap") >= spare)
        held, rest, n = (new, open_.where(F.col("offset") == 0).count()), open_, sizes[1] or 0
        if groups == 1:
            break
    if held is not None:
        done.append(held[0])
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    if ids:
        out = out.join(whole.select("number", "ids"), "number")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids)


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, its pieces in the order of their offsets."""
    each = F.array_sort(F.array_agg(F.struct("offset", "ids")))
    return pieces_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(each, lambda x: x["ids"])).alias("ids"))
