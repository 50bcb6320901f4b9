"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Each pattern offers
its words `most` times: the first time at cost 0, each repetition at a higher cost. A min-cost flow routes
these words to the sources' targets, so words repeat only where unique ones are used up. Within a
pattern documents stand on a line in a seeded order, and the flow's amount is taken from its start;
the document at the end is taken in part, so each source's words meet its target but for rounding.

Only sums by pattern and source reach the driver (`max_sources` and `max_patterns` bound them). The place
on the line comes from sums of hash buckets and a window within one bucket, so a source that holds
a third of all rows is dealt over many tasks.

Defined results: a null text has size 0; a null source is a source of its own, the last; an empty table
gives an empty mix; a document without sources, or of size 0, is not taken; repeated rows count each;
rows alike in doc_id and size may swap places, which changes no result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import before_buckets, shared_folder, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixRules:
    """weights: of the sources in order, repeating; share: of all sizes together, what is taken;
    most: times a word is taken at most."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: int = 17
    bucket_rows: int = 500
    max_sources: int = 50_000
    max_patterns: int = 200_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: Sequence[int], total: int, rules: MixRules) -> list[float]:
    """Shares of the whole by weight; what exceeds `most` times a source's size is shared among the others, again and again."""
    weights = [rules.weights[k % len(rules.weights)] for k in range(len(sizes))]
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), rules.share * total
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * unit > rules.most * sizes[k]}
        for k in full or open_:
            targets[k] = float(rules.most * sizes[k]) if full else weights[k] * unit
        if not full:
            break
        left -= sum(rules.most * sizes[k] for k in full)
        open_ -= full
    return targets


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], most: int) -> list[dict[int, int]]:
    """Words that go from each pattern to each source. A pattern's words cost as much as the times they
    were taken before, which is convex; so augmenting along cheapest paths means using up the capacity of one
    round, by paths that may reroute earlier flow, before opening the next round."""
    flow: list[dict[int, int]] = [{s: 0 for s in m} for m in members]
    holders: dict[int, list[int]] = {}
    for p, m in enumerate(members):
        for s in m:
            holders.setdefault(s, []).append(p)
    want = list(quota)
    for _ in range(most):
        left = list(capacity)
        for start in range(len(members)):
            while left[start]:
                path = _path(start, members, holders, flow, want)
                if path is None:
                    break
                # path: p0, s0, p1, s1, ...: p0 gains at s0, p1 loses at s0 and gains at s1, and so on
                amount = min([left[start], want[path[-1]], *(flow[path[i]][path[i - 1]] for i in range(2, len(path), 2))])
                for i in range(0, len(path), 2):
                    flow[path[i]][path[i + 1]] += amount
                    if i:
                        flow[path[i]][path[i - 1]] -= amount
                left[start] -= amount
                want[path[-1]] -= amount
    return flow


def _path(start, members, holders, flow, want) -> list[int] | None:
    """Shortest way from a pattern to a source that wants words, breadth first."""
    came: dict[int, tuple[int, int | None]] = {}  # source: (pattern before it, source before that)
    queue: deque[tuple[int, int | None]] = deque([(start, None)])
    seen = {start}
    while queue:
        p, by = queue.popleft()
        for s in members[p]:
            if s in came:
                continue
            came[s] = (p, by)
            if want[s] > 0:
                path, at = [], s
                while at is not None:
                    p, by = came[at]
                    path += [at, p]
                    at = by
                return path[::-1]
            for q in holders[s]:
                if q not in seen and flow[q][s] > 0:
                    seen.add(q)
                    queue.append((q, s))
    return None


def _bounded(df: DataFrame, most: int, what: str) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def mix(docs: DataFrame, sources: Column | None = None, rules: MixRules = MixRules(), carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: the columns `carry`, size, sources, source_size and target (arrays in the
    order of sources), and taken, an array of the words taken for each source.

    sources: an array of a document's sources; by default its column `source` alone.
    """
    spark: SparkSession = docs.sparkSession
    sources = F.array("source") if sources is None else sources
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(rules.seed))).otherwise(F.xxhash64("doc_id", F.lit(rules.seed)))
    own = [F.array_sort(F.array_distinct(sources)).alias("_sources"), word_count("text").alias("_size"), F.col("doc_id").alias("_id"), place.alias("_place")]
    # what follows reads a table without texts; only columns that are carried along are read again, with one more count
    thin = written(docs.select(*own), shared_folder(spark))
    sized = thin.withColumn("doc_id", F.col("_id")) if tuple(carry) == ("doc_id",) else docs.select(*carry, *own)
    pattern = F.coalesce(F.to_json("_sources"), F.lit("")).alias("_pattern")
    sized = sized.withColumn("_pattern", pattern)
    bits = max(1, min(24, (thin.count() // rules.bucket_rows).bit_length()))
    bucket = F.shiftrightunsigned("_place", 64 - bits).alias("_bucket")
    buckets = thin.groupBy(pattern, F.col("_sources"), bucket).agg(F.sum("_size").alias("_words"))
    buckets = written(buckets, shared_folder(spark))
    patterns = _bounded(buckets.groupBy("_pattern").agg(F.first("_sources").alias("sources"), F.sum("_words").alias("words")).orderBy("_pattern"), rules.max_patterns, "patterns")
    names = sorted({s for p in patterns for s in p.sources or []}, key=lambda s: (s is None, (s or "").encode()))
    if len(names) > rules.max_sources:
        raise ValueError(f"more than {rules.max_sources} sources")
    number = {s: k for k, s in enumerate(names)}
    members = [[number[s] for s in p.sources or []] for p in patterns]
    size = [0] * len(names)
    for p, m in zip(patterns, members):
        for s in m:
            size[s] += p.words
    target = source_targets(size, sum(p.words for p in patterns), rules)
    flow = min_cost_flow([p.words for p in patterns], members, [int(t) for t in target], rules.most)
    plan = []
    for p, m, f in zip(patterns, members, flow):
        ends, at = [], 0
        for s in m:
            at += f[s]
            ends.append(at)
        plan.append((p._pattern, p.words, ends, [size[s] for s in m], [target[s] for s in m]))
    plan = spark.createDataFrame(plan, "_pattern string, _all long, _ends array<long>, source_size array<long>, target array<double>")
    before = written(before_buckets(buckets, ["_pattern"], "_bucket", "_words", "_before"), shared_folder(spark))
    own = Window.partitionBy("_pattern", "_bucket").orderBy("_place", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_bucket", bucket).withColumn("_own", F.coalesce(F.sum("_size").over(own), F.lit(0)))
    # the plan has one row for each pattern, of which max_patterns are allowed
    placed = placed.join(before, ["_pattern", "_bucket"]).join(F.broadcast(plan), "_pattern").withColumn("_from", F.col("_before") + F.col("_own"))
    taken = f"""transform(_ends, (e, k) -> aggregate(sequence(0, {rules.most - 1}), 0L, (t, r) -> t + greatest(0L,
        least(_from + _size + r * _all, e) - greatest(_from + r * _all, if(k = 0, 0L, _ends[k - 1])))))"""
    return placed.select(*carry, F.col("_size").alias("size"), F.col("_sources").alias("sources"), "source_size", "target", F.expr(taken).alias("taken"))


def mixed_documents(docs: DataFrame, sources: Column | None = None, rules: MixRules = MixRules()) -> DataFrame:
    """The mix as documents with the columns of docs: each as often as it is taken, the last time in part
    (its first words, as they stand). n_chars, if there is such a column, is counted again."""
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select("*", *(F.col(c).alias(n) for c, n in names.items()))
    mixed = mix(renamed, sources, rules, tuple(names.values()))
    words = F.expr("aggregate(taken, 0L, (a, b) -> a + b)")
    part = mixed.withColumn("_words", words).where("_words > 0").withColumn("_part", F.expr("explode(transform(sequence(1L, ceil(_words / size)), k -> least(size, _words - (k - 1) * size)))"))
    text = names["text"]
    first = F.expr(f"concat_ws('', slice(split({text}, '(?<=[^\\\\x20\\\\x09-\\\\x0D])(?=[\\\\x20\\\\x09-\\\\x0D])', -1), 1, cast(_part as int)))")
    part = part.withColumn(text, F.when(F.col("_part") < F.col("size"), first).otherwise(F.col(text)))
    out = part.select(*(F.col(n).alias(c) for c, n in names.items()))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
