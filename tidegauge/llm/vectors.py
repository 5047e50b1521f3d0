"""Tables of vectors: which of them count, and their rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(rows: DataFrame, vector: str = "embedding") -> tuple[Column, int]:
    """The condition that a row's vector is not null or zero, holds no null or non-finite component and has the commonest length (the longer of equals), and that length."""
    v = F.col(vector)
    sizes = rows.where(v.isNotNull() & (F.size(v) > 0)).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == d) & fine & F.exists(v, lambda x: x != 0), F.lit(False)), d


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """The vectors as rows, in their own precision."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def precision(rows: DataFrame, vector: str = "embedding") -> str:
    """The numpy type that holds the vectors unchanged."""
    return "f4" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "f8"


def closest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to those of ``b``, as good as the precision of a product of matrices."""
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
