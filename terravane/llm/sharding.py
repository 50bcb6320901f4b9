"""Balanced label propagation: shards of equal row counts that keep linked documents together.

Documents with equal texts are linked. Each group of them is a node, cut into chunks of bounded size
when it is large, and the state is a table of how many of a node's documents each shard holds. Every round
joins nodes to the shard where most of their neighbours are, among those with room for the node, and moves them there as
far as that shard's quota has room, the largest gains first, until no move is granted; the state is a written table after each round. Documents without links then fill
what is left of the quotas, so shard sizes differ by one row at most (law `rows`).

Ranks over all rows come from counts of hash buckets and windows within one bucket, so no task ever
sees a whole shard or a whole group of copies.

Defined results: a null text counts as empty, both for its size and its links; repeated rows are linked and
placed one by one; with fewer rows than shards the last shards stay empty; an empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before_buckets, shared_folder, written


@dataclass(frozen=True)
class ShardRules:
    """chunk_rows: a group's documents in one node, about, and an eighth of a quota at most; rounds: of moves, at most;
    bucket_rows: rows of one ranking window, about."""

    shards: int = 16
    rounds: int = 30
    chunk_rows: int = 2_000
    bucket_rows: int = 500
    gains: int = 32
    cells: int = 64


def ranked(rows: DataFrame, by: list[str], order: list[str | Column], n: int, bucket_rows: int, name: str) -> DataFrame:
    """rows with their rank from 0 within `by`, in order of a hash of doc_id (of grp, where that is null): the count of earlier buckets, and
    a window within a bucket. n: of rows, about."""
    bits = max(1, min(24, (n // bucket_rows).bit_length()))
    keys = [*by, "_bucket"]
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("grp")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("_place", place).withColumn("_bucket", F.shiftrightunsigned("_place", 64 - bits))
    before = before_buckets(rows.groupBy(*keys).agg(F.count("*").alias("_n")), by, "_bucket", "_n", "_before")
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("_place", *order)) - 1
    return rows.withColumn("_own", own).join(before, keys).withColumn(name, F.col("_before") + F.col("_own")).drop("_place", "_bucket", "_before", "_own")


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (k < n % shards) for k in range(shards)]


def propagate(state: DataFrame, quotas: list[int], rules: ShardRules) -> DataFrame:
    """state (grp, chunk, shard, n) after the rounds of moves. quotas: rows that each shard may hold."""
    spark = state.sparkSession
    state = written(state)
    for k in range(rules.rounds):
        held = {r.shard: r.held for r in state.groupBy("shard").agg(F.sum("n").alias("held")).collect()}
        room = spark.createDataFrame([(k, max(0, q - held.get(k, 0))) for k, q in enumerate(quotas)], "target int, room long")
        # nodes go where most of their group is, among the shards that hold it and have room for what is elsewhere
        whole = written(state.groupBy("grp", "shard").agg(F.sum("n").alias("near")), shared_folder(spark))
        sizes = written(state.groupBy("grp", "chunk").agg(F.sum("n").alias("total")), shared_folder(spark))
        own = state.select("grp", "chunk", F.col("shard").alias("target"), F.col("n").alias("own"))
        seen = sizes.join(whole.withColumnRenamed("shard", "target"), "grp").join(own, ["grp", "chunk", "target"], "left").join(F.broadcast(room), "target")
        seen = seen.withColumn("own", F.coalesce("own", F.lit(0))).where("total - own <= room")
        best = seen.groupBy("grp", "chunk").agg(F.max(F.struct("near", "own", (-F.col("target")).alias("minus"))).alias("best"))
        best = best.select("grp", "chunk", (-F.col("best.minus")).cast("int").alias("target"), F.col("best.near").alias("most"))
        cell = F.pmod(F.xxhash64("grp", "chunk", F.lit(k)), F.lit(rules.cells << min(k, 3))).cast("int")
        moves = state.join(best, ["grp", "chunk"], "left").withColumn("gain", F.least(F.col("most"), F.lit(rules.gains))).withColumn("cell", cell)
        moves = written(moves, shared_folder(spark))
        asked = moves.where("shard != target").groupBy("target", "gain", "cell").agg(F.sum("n").alias("asked"))
        order = Window.partitionBy("target").orderBy(F.desc("gain"), "cell")
        # at most 8 * shards * gains * cells rows; a cell that doesn't fit by itself holds up no other
        fits = asked.join(F.broadcast(room), "target").where("asked <= room").withColumn("sum", F.sum("asked").over(order)).where("sum <= room")
        granted = written(fits.select("target", "gain", "cell", F.lit(True).alias("granted")), shared_folder(spark))
        if granted.isEmpty():
            if k >= 3:  # cells are as fine as they get
                break
            continue
        moved = moves.join(F.broadcast(granted), ["target", "gain", "cell"], "left")
        state = moved.select("grp", "chunk", F.when(F.col("granted"), F.col("target")).otherwise(F.col("shard")).alias("shard"), "n").groupBy("grp", "chunk", "shard").agg(F.sum("n").alias("n"))
        state = written(state)
    return state


def sharded(docs: DataFrame, rules: ShardRules = ShardRules()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"))
    rows = written(rows, shared_folder(spark))
    n = rows.count()
    quotas = _quotas(n, rules.shards)
    # as a table, so that the join stands on two plain exchanges and Spark can split a large group
    groups = written(rows.groupBy("grp").agg(F.count("*").alias("copies")).where("copies > 1"), shared_folder(spark))
    joined = rows.join(groups, "grp", "left")
    most = max(1, min(rules.chunk_rows, n // rules.shards // 8))
    chunks = F.greatest(F.ceil(F.col("copies") / most), F.lit(1))
    linked = joined.where("copies IS NOT NULL").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(1)), chunks).cast("int")).drop("copies")
    linked = written(linked, shared_folder(spark))
    first = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(rules.shards)).cast("int")
    state = propagate(linked.groupBy("grp", "chunk", first.alias("shard")).agg(F.count("*").alias("n")), quotas, rules)
    # the documents of a node are alike: the first ones go to its first shard, and so on
    ends = state.withColumn("end", F.sum("n").over(Window.partitionBy("grp", "chunk").orderBy("shard")))
    ends = ends.groupBy("grp", "chunk").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    at = F.row_number().over(Window.partitionBy("grp", "chunk").orderBy(F.xxhash64("doc_id"), "doc_id"))
    placed = linked.withColumn("at", at).join(ends, ["grp", "chunk"])
    placed = placed.withColumn("shard", F.expr("element_at(filter(ends, e -> e.end >= at), 1).shard")).drop("at", "ends", "chunk")
    placed = written(ranked(placed, ["shard"], ["doc_id", "grp"], n, rules.bucket_rows, "slot"), shared_folder(spark))
    quota = F.array(*(F.lit(q) for q in quotas))
    fits = F.col("slot") < F.element_at(quota, F.col("shard") + 1)
    kept = placed.where(fits)
    held = {r.shard: r.held for r in kept.groupBy("shard").agg(F.count("*").alias("held")).collect()}
    columns = ["doc_id", "size", "text_crc32", "grp"]
    free = joined.where("copies IS NULL").select(columns).union(placed.where(~fits).select(columns)).withColumn("_all", F.lit(0))
    free = ranked(free, ["_all"], ["doc_id", "grp"], n, rules.bucket_rows, "rank")
    room, start, rank = [], 0, F.col("rank")
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, q in enumerate(quotas):
        begin, start = start, start + q - held.get(k, 0)
        room.append((k, begin, start, held.get(k, 0)))
    for k, begin, end, base in reversed(room):
        inside = (rank >= begin) & (rank < end)
        shard, slot = F.when(inside, k).otherwise(shard), F.when(inside, rank - begin + base).otherwise(slot)
    free = free.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.alias("slot"))
    out = kept.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")).union(free)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
