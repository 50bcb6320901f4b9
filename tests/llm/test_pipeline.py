"""The pipeline's stages against brute force, on odd rows and on empty tables, and the registered queries on a small scale factor."""

from __future__ import annotations

import collections
import random
import re

import pytest
from test_similar import least_of_each

import corpus_pipeline
from terravane.llm.bpe import word_bpe
from terravane.llm.common import table
from terravane.llm.mixing import mix
from terravane.llm.quality import quality_report
from terravane.llm.queries import QUERIES, tokenizer

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "[\x20\x09-\x0d]"
SECRETS = (
    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", 0),
    (r"AKIA[A-Z0-9]{12,}", 1),
    (r"[0-9a-f]{32,}", 2),
)


def words(text):
    return [w for w in re.split(SPACE + "+", text or "") if w]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def check_stages(spark, docs, sf_dir, folder):
    """Runs all stages one by one and holds each against what its input demands."""
    before = rows_of(docs)
    columns = docs.columns
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == columns
        got.write.parquet(f"{folder}/{name}")
        source, docs = docs, spark.read.schema(got.schema).parquet(f"{folder}/{name}")
        out[name] = rows_of(docs)
        if name == "quality_rules":
            report = quality_report(source, table(spark, sf_dir, "labels"))
            want = collections.Counter(r.doc_id for r in report.collect() if r.kept)
            assert collections.Counter(r[0] for r in out[name]) == want
            assert not collections.Counter(out[name]) - collections.Counter(before)
        elif name == "near_dedup":
            want, every = least_of_each([r[:2] for r in before])
            assert sorted((r[0] is None, r[0] or 0) for r in out[name]) == sorted(want)
            assert {r[:2] for r in out[name]} <= every and set(out[name]) <= set(before)
        elif name == "secret_scan":
            after = {(r[0], r[3], k): r for r, k in numbered(out[name])}
            assert len(out[name]) == len(before)
            for r, k in numbered(before):
                new = after[r[0], r[3], k]
                assert new[2:4] == r[2:4] and (new[1] is None) == (r[1] is None)
                if r[1] is not None:
                    assert new[4] == len(new[1]) or r[4] is None
                    assert not any(re.search(p, new[1]) for p, _ in SECRETS)
                    if not any(re.search(p, r[1]) for p, _ in SECRETS) and not re.search(r"%[0-9A-Fa-f]{2}|\\[ux]|[A-Za-z0-9+/_-]{16}", r[1]):
                        assert new[1] == r[1]
        elif name == "mixing":
            taken = collections.Counter()
            for r in mix(source).collect():
                taken[r.doc_id] += r.taken[0]
            got_words = collections.Counter()
            for r in out[name]:
                got_words[r[0]] += len(words(r[1]))
            assert +got_words == +taken
            texts = collections.defaultdict(set)
            for r in before:
                texts[r[0]].add(r[1])
            assert all(any(t and t.startswith(r[1]) for t in texts[r[0]]) for r in out[name])
        elif name == "bpe":
            whole = word_bpe(tokenizer("word_bpe_49k.json")).whole
            want = collections.Counter((r[0], tuple(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in before)
            assert collections.Counter((r.doc_id, tuple(r.ids)) for r in docs.collect()) == want
        before = out[name]
    return out


def numbered(rows):
    """Rows with their number among those of the same id and source, in order of their texts' first characters."""
    seen = collections.Counter()
    for r in sorted(rows, key=lambda r: (r[1] or "")[:4]):
        yield r, seen[r[0], r[3]]
        seen[r[0], r[3]] += 1


def test_pipeline(spark, sf, tmp_path):
    out = check_stages(spark, table(spark, sf, "documents"), sf, tmp_path)
    assert all(out.values())


def folder_of(spark, rows, path):
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, secrets."""
    rng = random.Random(2)
    vocabulary = [f"wort{k}" for k in range(80)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(12)]
    rows = [(k, t, "de", "ab"[k % 2], len(t)) for k, t in enumerate(texts)]
    rows += [(0, texts[1], "de", "a", 1), (0, texts[0], "de", "a", 1), rows[3], rows[3], (None, texts[4], None, None, None), (None, texts[4] + " more", None, None, None)]
    rows += [(20, None, "de", "a", 0), (21, "", "de", None, 0), (22, " \n ", "de", "b", 3), (23, texts[5] + ' password = "hunter2Secret99" ' + texts[6], "de", "b", 5), (24, " ".join(rng.choice(vocabulary) for _ in range(6000)), "de", "c", 9), (None, " ".join(rng.choice(vocabulary) for _ in range(70)), "de", "a", 2)]
    sf_dir = folder_of(spark, rows, tmp_path / "sf")
    out = check_stages(spark, table(spark, sf_dir, "documents"), sf_dir, tmp_path / "out")
    assert {None, 24} <= {r[0] for r in out["near_dedup"]}
    assert rows_of(corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").orderBy("doc_id", "n_tokens")) == sorted(((r[0], r[1]) for r in out["bpe"]), key=lambda x: (x[0] is not None, x))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    sf_dir = folder_of(spark, [], tmp_path / "sf")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


#: Of these, op1, op11 and op12 read embeddings, and op13 has a row for each piece of a document.
OTHER_ROWS = ("op1_media", "op11_vector_codes", "op12_hard_negatives", "op13_packing")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in OTHER_ROWS])
def test_one_row_a_document(spark, sf, name):
    assert QUERIES[name](spark, sf).count() == table(spark, sf, "documents").count()
