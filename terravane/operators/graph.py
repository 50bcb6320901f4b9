"""Regions of cells and distances on networks: iterations of joins, each round a written table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..session import shared_folder, written
from .joins import QUEEN, neighbours


def _with_least(links: DataFrame) -> DataFrame:
    """links (u, v) with the least v of each u. The minima are dealt out once more before the join, so that it stands on two
    plain exchanges and Spark can split the links of a hub."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("least")).repartition(F.xxhash64("u")), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    starred = _with_least(links)
    return starred.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(starred.select("u", F.col("least").alias("v"))).distinct()


def _counted(links: DataFrame) -> tuple[DataFrame, tuple]:
    """links as a written table, with their number and a sum of their hashes, both taken as they are written."""
    seen = Observation()
    table = written(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")))
    return table, (seen.get["n"], seen.get["hashes"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a few links in one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], ["node", "root"])


def components(links: DataFrame, rounds: int = 60, few: int = 50_000) -> DataFrame:
    """(node, root) of every node in links (u, v): root is the least node of its component. Up to `few` links, whole numbers, are
    joined in one task, which spares the rounds and gives the same.

    Large-star and small-star operations alternate until the links stay as they are, which takes about
    as many rounds as the logarithm of the longest path. No neighbourhood is gathered in one place: each step is a
    minimum, combined before the shuffle, and a join whose hot keys Spark can split.
    """
    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, now = _counted(links)
    if now[0] <= few and dict(links.dtypes)["u"] in ("int", "bigint"):
        return links.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined, "node long, root long")
    for _ in range(rounds):
        if not now[0]:
            break
        before = now
        links, now = _counted(_small_star(written(_large_star(links))))
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def regions(cells: DataFrame, offsets: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    """(r, c, label): cells given as (r, c) with the least cell number of the region they are connected to."""
    number = F.col("r").cast("long") * (1 << 31) + F.col("c")
    cells = written(cells.select("r", "c").distinct().withColumn("label", number))
    links = neighbours(cells, "label", offsets).select(F.col("label").alias("u"), F.col("other").alias("v"))
    roots = components(links)
    joined = cells.join(roots, cells.label == roots.node, "left")
    return joined.select("r", "c", F.coalesce("root", "label").alias("label"))


def despeckled(cells: DataFrame, least: int, offsets: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    """(r, c, label, size) of the cells in regions of `least` cells or more."""
    labelled = regions(cells, offsets)
    sizes = labelled.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return labelled.join(sizes, "label").select("r", "c", "label", "size")


def border_regions(cells: DataFrame, rows: int, columns: int, offsets: Sequence[tuple[int, int]] = QUEEN) -> DataFrame:
    """(r, c) of the cells whose region touches the frame of the grid, as open sea does."""
    labelled = written(regions(cells, offsets))
    frame = labelled.where((F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == rows - 1) | (F.col("c") == columns - 1)).select("label").distinct()
    return labelled.join(frame, "label", "left_semi").select("r", "c")


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, len) in both directions, the shortest of parallel edges, without loops."""
    one = edges.where("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("len").alias("len"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "len").union(one.select(F.col("b").alias("src"), F.col("a").alias("dst"), "len"))


def _sized(df: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """df as a written table, with the number of its rows, taken as it is written."""
    seen = Observation()
    return written(df.observe(seen, F.count("*").alias("n")), folder), seen.get["n"]


def distances(edges: DataFrame, sources: DataFrame, cutoff: float, rounds: int = 1000, merge: int = 8) -> DataFrame:
    """(node, dist): distance of every node within `cutoff` of the nearest source, along edges (src, dst, len).

    Each round relaxes the edges of the nodes that came nearer in the last one and writes those alone that came nearer now, so far
    nodes cost nothing; what earlier rounds have written is merged every few rounds, so a round opens a bounded number of folders.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession)
    edges = written(undirected(edges))
    front, n = _sized(sources.select("node", F.lit(0.0).alias("dist")).distinct(), f"{folder}/0")
    held = [f"{folder}/0"]
    for k in range(1, rounds):
        known = spark.read.schema(front.schema).parquet(*held)
        if not n:
            break
        if len(held) > merge:
            known = written(known.groupBy("node").agg(F.min("dist").alias("dist")), f"{folder}/merged{k}")
            held = [f"{folder}/merged{k}"]
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node"), (F.col("dist") + F.col("len")).alias("dist")).where(F.col("dist") <= cutoff)
        step = step.groupBy("node").agg(F.min("dist").alias("dist"))
        old = known.join(step.select("node"), "node", "left_semi").groupBy("node").agg(F.min("dist").alias("old"))
        nearer = step.join(old, "node", "left").where(F.col("old").isNull() | (F.col("dist") < F.col("old"))).select("node", "dist")
        front, n = _sized(nearer, f"{folder}/{k}")
        held.append(f"{folder}/{k}")
    else:
        raise RuntimeError(f"distances did not settle in {rounds} rounds")
    return known.groupBy("node").agg(F.min("dist").alias("dist"))


def walk_edges(ways: DataFrame, way: str, order: str, node: str, x: str, y: str) -> DataFrame:
    """Edges between consecutive nodes of ways, by haversine length in metres."""
    w = Window.partitionBy(way).orderBy(order)
    nexts = ways.select(node, x, y, F.lead(node).over(w).alias("_to"), F.lead(x).over(w).alias("_x"), F.lead(y).over(w).alias("_y")).where("_to IS NOT NULL")
    return nexts.select(F.col(node).alias("src"), F.col("_to").alias("dst"), (haversine_km(F.col(x), F.col(y), F.col("_x"), F.col("_y")) * 1000).alias("len"))
