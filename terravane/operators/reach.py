"""Cells near lines: lines as cells, and exact distances of cells to the nearest marked one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_cells(lines: DataFrame, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> DataFrame:
    """(r, c): all unit cells that segments pass through, each once. Coordinates are in cell units: cell (r, c) holds c <= x < c + 1."""
    turned = F.col(x1) > F.col(x2)
    ends = lines.select(*(F.when(turned, F.col(b)).otherwise(F.col(a)).cast("double").alias(n) for a, b, n in ((x1, x2, "_x"), (y1, y2, "_y"), (x2, x1, "_u"), (y2, y1, "_v"))))
    columns = ends.where("_x IS NOT NULL AND _y IS NOT NULL AND _u IS NOT NULL AND _v IS NOT NULL").withColumn("c", F.explode(F.sequence(F.floor("_x").cast("int"), F.floor("_u").cast("int"))))
    at = lambda x: F.when(F.col("_u") == F.col("_x"), None).otherwise(F.col("_y") + (F.col("_v") - F.col("_y")) * ((x - F.col("_x")) / (F.col("_u") - F.col("_x"))))
    into = F.when(F.col("c") > F.col("_x"), at(F.col("c"))).otherwise(F.col("_y"))
    out = F.when(F.col("c") + 1 < F.col("_u"), at(F.col("c") + 1)).otherwise(F.col("_v"))
    return columns.select(F.explode(F.sequence(F.floor(F.least(into, out)).cast("int"), F.floor(F.greatest(into, out)).cast("int"))).alias("r"), "c").distinct()


def squared_distances(marked: np.ndarray) -> np.ndarray:
    """Squared distance of every cell of a tile to the nearest marked one, exact: steps along the columns, then the lower envelope of one
    parabola for each column along the rows. Infinite where nothing is marked."""
    rows, columns = marked.shape
    steps = np.where(marked, 0.0, np.inf)
    for r in range(1, rows):
        np.minimum(steps[r], steps[r - 1] + 1, out=steps[r])
    for r in range(rows - 2, -1, -1):
        np.minimum(steps[r], steps[r + 1] + 1, out=steps[r])
    height = steps * steps
    line = np.arange(rows)
    vertex, since = np.zeros((rows, columns), np.int64), np.full((rows, columns + 1), np.inf)  # parabolas of the envelope, and where each one begins
    n = np.full(rows, -1)
    for q in range(columns):
        own = height[:, q]
        begin = np.full(rows, -np.inf)
        open_ = np.isfinite(own)
        check = open_ & (n >= 0)
        while check.any():
            i = np.flatnonzero(check)
            p = vertex[i, n[i]]
            begin[i] = (own[i] + q * q - height[i, p] - p * p) / (2.0 * (q - p))
            hidden = begin[i] <= since[i, n[i]]
            n[i[hidden]] -= 1
            check[:] = False
            check[i[hidden]] = n[i[hidden]] >= 0
            begin[i[hidden & (n[i] < 0)]] = -np.inf
        n[open_] += 1
        i = np.flatnonzero(open_)
        vertex[i, n[i]], since[i, n[i]] = q, begin[i]
        since[i, n[i] + 1] = np.inf
    out, k = np.full((rows, columns), np.inf), np.zeros(rows, np.int64)
    some = n >= 0
    for q in range(columns):
        ahead = some & (k < n) & (since[line, np.minimum(k + 1, columns)] <= q)
        while ahead.any():
            k[ahead] += 1
            ahead &= (k < n) & (since[line, np.minimum(k + 1, columns)] <= q)
        p = vertex[line, k]
        out[some, q] = (height[line, p] + (q - p) ** 2)[some]
    return out


def _near(tile: int, halo: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        top, left = table["_tr"][0].as_py() * tile - halo, table["_tc"][0].as_py() * tile - halo
        marked = np.zeros((tile + 2 * halo, tile + 2 * halo), bool)
        marked[table["r"].to_numpy() - top, table["c"].to_numpy() - left] = True
        d2 = squared_distances(marked)[halo : halo + tile, halo : halo + tile]
        r, c = np.nonzero(d2 <= most)
        return pa.table([pa.array((r + top + halo).astype(np.int32)), pa.array((c + left + halo).astype(np.int32)), pa.array(d2[r, c].astype(np.int64))], names=["r", "c", "d2"])

    return run


def near_cells(marked: DataFrame, reach: float, tile: int = 256) -> DataFrame:
    """(r, c, d2): all cells whose centre lies within `reach` (in cells) of the centre of a marked cell (r, c), with the squared distance.

    Marked cells go to their own tile and to those that their reach touches, so a tile has (tile + 2 * reach)^2 cells at most, however dense they are.
    """
    halo, most = math.floor(reach), math.floor(reach * reach)
    span = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / tile).cast("int"), F.floor((F.col(x) + halo) / tile).cast("int")))
    cells = marked.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).where("r IS NOT NULL AND c IS NOT NULL").distinct()
    dealt = cells.withColumn("_tr", span("r")).withColumn("_tc", span("c"))
    return dealt.groupBy("_tr", "_tc").applyInArrow(_near(tile, halo, most), "r int, c int, d2 long")


def served_cells(edges: DataFrame, size: float, reach: float, tile: int = 256) -> DataFrame:
    """(r, c, distance): the area within `reach` metres of served edges (x1, y1, x2, y2 in metres), as square cells of `size` metres. Distances are
    between cell centres, so they differ from those to the lines themselves by a cell's diagonal at most."""
    scaled = edges.select(*(F.col(k) / F.lit(float(size)) for k in ("x1", "y1", "x2", "y2"))).toDF("x1", "y1", "x2", "y2")
    return near_cells(line_cells(scaled), reach / size, tile).select("r", "c", (F.sqrt("d2") * size).alias("distance"))
