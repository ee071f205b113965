"""Vectors as packed rows and blocks, shared by the embedding operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each length of vector in the column; rows that are null, empty or hold
    null or non-finite components are left out."""
    column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)  # null components read as nan
    size = np.diff(offsets)
    size[column.is_null().to_numpy(zero_copy_only=False)] = 0
    for dims in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dims)
        values = flat[offsets[rows][:, None] + np.arange(dims)]
        good = np.isfinite(values).all(1)
        if good.any():
            yield rows[good], values[good]


def packed(values: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize
    offsets = np.arange(0, (len(values) + 1) * width, width)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def unpacked(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """The matrix of a column of equally long byte rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Intervals of equal keys in order."""
    if not len(keys[0]):
        return []
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    cut = [*np.flatnonzero(change).tolist(), len(change)]
    return list(zip(cut[:-1], cut[1:]))
