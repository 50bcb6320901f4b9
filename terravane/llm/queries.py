"""The numbered queries: each applies one operator to its whole table and returns the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoded
from .common import shared_folder, table
from .hardnegatives import mined_negatives
from .media import image_copies
from .mixing import mix
from .packing import packed
from .quality import quality_report
from .rendering import drawn
from .secrets import secret_spans
from .sharding import sharded
from .simhash import near_duplicates
from .suffixarray import repeated_bytes_removed
from .suffixtree import repeated_words_removed
from .tokencache import token_counts
from .vectorcodes import vector_codes


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over images drawn from all embeddings, since no table holds images; see rendering.py."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # drawing is most of the work, so vectors are spread over all tasks first, however few bytes they are
    vectors = vectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    return image_copies(drawn(vectors), "image_id", "image")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", *(F.col(c)[0].alias(c) for c in ("source_size", "target", "taken")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words_removed(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two deliveries with a cache of their own: what the first one encodes, the second one finds stored."""
    docs, path, cache = table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), shared_folder(spark)
    first = F.xxhash64("doc_id") >= 0
    return token_counts(docs.where(first), path, cache).union(token_counts(docs.where(~first), path, cache))


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes_removed(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels are wrong on purpose: where vec_id is divisible by 7, the next label stands for the own one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mined_negatives(rows)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES = {
    "op1_media": op1_media,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe": op5_bpe,
    "op6_suffix_trees": op6_suffix_trees,
    "op7_simhash": op7_simhash,
    "op8_secrets": op8_secrets,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_arrays": op10_suffix_arrays,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_packing": op13_packing,
}

#: SQL twins: suffix trees find what a join of windows finds, vector codes and hard negatives what joins of whole tables find. The other operators need hashes, tokenizers, regular
#: expressions with places, or iterations that SQL lacks; tests hold them against brute force.
SQL: dict[str, str] = {
    "op6_suffix_trees": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS k FROM d WHERE len(w) >= 13),
first AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id AS doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id AS doc_id, len(w)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op11_vector_codes": r"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
part AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c, list_inner_product(x, x) AS cc FROM part QUALIFY e < 256),
a1 AS MATERIALIZED (SELECT p, x, min({'d': cc - 2 * list_inner_product(x, c), 'e': e}).e AS e FROM part JOIN b0 USING (p) GROUP BY p, vec_id, x),
m1 AS (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS y FROM a1, generate_series(1, len(x)) t(i) GROUP BY p, e, i),
u1 AS (SELECT p, e, list(y ORDER BY i) AS c FROM m1 GROUP BY p, e),
b1 AS MATERIALIZED (SELECT p, e, c, list_inner_product(c, c) AS cc FROM (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b0 b LEFT JOIN u1 u ON u.p = b.p AND u.e = b.e)),
a2 AS MATERIALIZED (SELECT p, x, min({'d': cc - 2 * list_inner_product(x, c), 'e': e}).e AS e FROM part JOIN b1 USING (p) GROUP BY p, vec_id, x),
m2 AS (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS y FROM a2, generate_series(1, len(x)) t(i) GROUP BY p, e, i),
u2 AS (SELECT p, e, list(y ORDER BY i) AS c FROM m2 GROUP BY p, e),
b2 AS MATERIALIZED (SELECT p, e, c, list_inner_product(c, c) AS cc FROM (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b1 b LEFT JOIN u2 u ON u.p = b.p AND u.e = b.e)),
a3 AS MATERIALIZED (SELECT p, x, min({'d': cc - 2 * list_inner_product(x, c), 'e': e}).e AS e FROM part JOIN b2 USING (p) GROUP BY p, vec_id, x),
m3 AS (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS y FROM a3, generate_series(1, len(x)) t(i) GROUP BY p, e, i),
u3 AS (SELECT p, e, list(y ORDER BY i) AS c FROM m3 GROUP BY p, e),
b3 AS MATERIALIZED (SELECT p, e, c, list_inner_product(c, c) AS cc FROM (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b2 b LEFT JOIN u3 u ON u.p = b.p AND u.e = b.e)),
a4 AS MATERIALIZED (SELECT p, x, min({'d': cc - 2 * list_inner_product(x, c), 'e': e}).e AS e FROM part JOIN b3 USING (p) GROUP BY p, vec_id, x),
m4 AS (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS y FROM a4, generate_series(1, len(x)) t(i) GROUP BY p, e, i),
u4 AS (SELECT p, e, list(y ORDER BY i) AS c FROM m4 GROUP BY p, e),
b4 AS MATERIALIZED (SELECT p, e, c, list_inner_product(c, c) AS cc FROM (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b3 b LEFT JOIN u4 u ON u.p = b.p AND u.e = b.e)),
near AS (SELECT vec_id, p, min({'d': cc - 2 * list_inner_product(x, c), 'e': e}) AS m, any_value(list_inner_product(x, x)) AS xx FROM part JOIN b4 USING (p) GROUP BY vec_id, p),
code AS (SELECT vec_id, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, sum(m.d + xx)::BIGINT AS error FROM near GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM code JOIN kept USING (vec_id), book
""",
    "op12_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
""",
}
