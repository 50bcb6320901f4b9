"""Vectors of whole numbers, which the vector operators share.

Defined results: a row whose vector is null or empty, or holds a null or non-finite component, is left out. The length of
the vectors is that of the kept row with the least vec_id (null last, then the shortest); rows of another length are left out.
Whole components whose sum of squares reaches a limit (2**60, or the operator's own) end the run with an error, since what
is computed from them can exceed 64 bits. Repeated rows stay rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column whose lists all have `width` items and no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _floored(scale: int, most: float):
    def run(batches):
        for batch in batches:
            lists = pc.fill_null(batch.column(2), pa.scalar([], batch.column(2).type))
            lengths = pc.list_value_length(lists).to_numpy()
            flat = pc.cast(lists.flatten(), pa.float64())
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
            odd = np.concatenate(([0], np.cumsum(~np.isfinite(x), dtype=np.int64)))
            good = (lengths > 0) & (odd[starts[1:]] == odd[starts[:-1]])
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(x * float(scale))
            inside = np.repeat(good, lengths)
            x, lengths = x[inside], lengths[good].astype(np.int64)
            if len(lengths):
                edges = np.concatenate(([0], np.cumsum(lengths)))
                squares = np.add.reduceat(x * x, edges[:-1])
                if not (squares < most).all():
                    raise ValueError(f"a vector's whole components have a sum of squares of {squares.max():.3g}; it must stay below {most:.3g}")
            else:
                edges, squares = np.zeros(1, np.int64), np.zeros(0)
            vector = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x.astype(np.int64)))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), vector], ["vec_id", "label", "vector"])

    return run


def whole_vectors(rows: DataFrame, scale: int, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", most: int = 1 << 60) -> tuple[DataFrame, int]:
    """row (long, one of its own for each row), vec_id, label and vector (array<long>: floor(scale * x)) as a written
    table, and the length of its vectors (0: no rows)."""
    label_type = dict(rows.dtypes)[label]
    some = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    whole = some.mapInArrow(_floored(scale, float(most)), f"vec_id long, label {label_type}, vector array<long>")
    whole = written(whole.withColumn("row", F.monotonically_increasing_id()))
    first = whole.agg(F.min(F.struct(F.col("vec_id").isNull(), F.col("vec_id"), F.size("vector").alias("n"))).alias("m")).select("m.n").first()
    width = first.n or 0
    return whole.where(F.size("vector") == width), width
