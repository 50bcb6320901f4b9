"""Token counts through a digest cache.

The cache is a Parquet folder of (content digest, tokens), one subfolder for each tokenizer version
(the digest of the tokenizer's file). Documents are joined to it by the digest of their normalised
content; only distinct contents that the cache lacks are encoded, and their counts are appended.
Normalised content is what the tokenizer's own normaliser gives; this file has none, so it is the
text's UTF-8 bytes, and a null text counts as empty.

Copies are removed within each task before texts are shuffled, so a text that a third of all rows
share reaches its reducer once for each task. The join back to documents carries digests only.

Defined results: an empty text has 0 tokens; special strings inside a text are special tokens, as by
default; two writers that append the same digest do no harm, since readers take each digest once.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import parts, shared_folder, written

_CACHE = "digest binary, n_tokens long"
#: Letters whose Unicode classes have long been fixed; other texts go to the tokenizers library itself.
_LATIN = re.compile("[\\x00-ȿ]*")


class ByteBpe:
    """Counts of a byte-level BPE file. Its vocabulary lists tokens in merge order, so ids are ranks too."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        spec, letters = json.load(open(path, encoding="utf-8")), byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        # fixed value: the pattern of this tokenizer's byte-level splitting
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def count(self, text: str) -> int:
        if _LATIN.fullmatch(text):
            return len(self.fast.encode(text, allowed_special="all"))
        return len(self.exact.encode(text, add_special_tokens=False).ids)


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(path)


def _encode(path: str):
    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            for part in parts(batch, 1):
                counts = [bpe.count(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _cached(df: DataFrame, folder: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.schema(_CACHE).parquet(folder).dropDuplicates(["digest"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each document.

    path: the tokenizer's file, on the driver and every executor; cache: the cache's folder, which all share.
    """
    folder = f"{cache}/{tokenizer_version(path)}"
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    contents = docs.select(digest, text.alias("text")).dropDuplicates(["digest"])
    known = _cached(docs, folder)
    misses = contents if known is None else contents.join(known, "digest", "left_anti")
    misses.mapInArrow(_encode(path), _CACHE).write.mode("append").parquet(folder)
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest)
    # as a table, so that the join stands on two plain exchanges and Spark can split a digest that many rows share
    counts = written(_cached(docs, folder), shared_folder(docs.sparkSession))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
