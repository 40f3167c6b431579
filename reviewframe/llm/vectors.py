"""Vectors as bytes: which ones take part, packing, and the best of a block of scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: str) -> Column:
    """True where a vector is not null and all of its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A column of arrays as a matrix; missing components of shorter ones are zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dimension).all():
        return flat.reshape(-1, dimension)
    out = np.zeros((len(sizes), dimension), dtype=flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """A value of bytes for each row."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(
        pa.binary())


def unpacked(values, dtype: str, dimension: int) -> np.ndarray:
    """The matrix whose rows were packed."""
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(-1, dimension)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties to the smaller column; -inf is no score."""
    width = scores.shape[1]
    edge = np.partition(scores, width - k, axis=1)[:, width - k, None] if width > k else np.full((len(scores), 1), -np.inf)
    row, column = np.nonzero((scores >= edge) & (scores > -np.inf))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]
