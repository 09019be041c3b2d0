"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null, not all zero, and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def packed(column: pa.ListArray, good: pa.BooleanArray, kind: str) -> pa.Array:
    """Vectors (lists of numbers) as the bytes of numpy's type `kind`, -0 as 0; null where good is false, or a vector is null,
    all zero, or has components that are null or not finite."""
    ends = column.offsets.to_numpy().astype(np.int64)
    x = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # null as nan
    ends -= ends[0]

    def count(at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(at)])
        return sums[ends[1:]] - sums[ends[:-1]]

    use = good.to_numpy(zero_copy_only=False) & column.is_valid().to_numpy(zero_copy_only=False) & (count(~np.isfinite(x)) == 0) & (count(x != 0) > 0)
    at = pa.array((ends * x.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(column), [pa.array(use).buffers()[1], at.buffers()[1], pa.py_buffer(x.tobytes())])


def unpacked(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """What packed() gave for vectors of one length, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    column = column.cast(pa.binary())  # or a large one, by a setting
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(kind).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample(df: DataFrame, id_col: str, vector_col: str, rows: int) -> np.ndarray:
    """At most `rows` vectors, picked by a hash of their ids, on the driver."""
    picked = df.select(F.col(vector_col).cast("array<double>")).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(rows)
    return matrix(picked.toArrow().column(0))
