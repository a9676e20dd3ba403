"""Vectors in Arrow batches as numpy matrices, and checks of vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of doubles. Null vectors, null elements and rows of different lengths raise ValueError."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    values = column.flatten()
    if column.null_count or values.null_count:
        raise ValueError("vectors must not be null and must not hold nulls")
    if len(values) % len(column):
        raise ValueError("wrong dimensionality of the vectors")
    rows = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    ends = np.asarray(column.offsets)
    if not (np.diff(ends) == rows.shape[1]).all():
        raise ValueError("wrong dimensionality of the vectors")
    return rows


def listed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if len(rows) else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).reshape(-1)).cast(kind))


def dimension(df: DataFrame, vec: str = "vec") -> tuple[int, int]:
    """(rows, dimension) of a vector column, after one pass that checks it; (0, 0) if it is empty."""
    n, low, high, nulls = df.agg(
        F.count(F.lit(1)), F.min(F.size(vec)), F.max(F.size(vec)), F.sum((F.col(vec).isNull() | F.exists(vec, lambda x: x.isNull())).cast("long"))
    ).first()
    if not n:
        return 0, 0
    if nulls:
        raise ValueError("vectors must not be null and must not hold nulls")
    if low != high or low < 1:
        raise ValueError("wrong dimensionality of the vectors")
    return n, low
