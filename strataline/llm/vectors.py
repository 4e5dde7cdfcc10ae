"""Embeddings as rows of raw doubles, for the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Rows of a binary column that hold equally many numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, width * len(rows) + 1, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a list column, by length of the lists: places and rows as doubles of those that are not null, not empty and all finite."""
    column = column.cast(pa.list_(pa.float64())) if column.type != pa.list_(pa.float64()) else column
    offsets = column.offsets.to_numpy()
    values = column.values
    finite = np.isfinite(values.fill_null(np.nan).to_numpy(zero_copy_only=False))
    bad = np.concatenate(([0], np.cumsum(~finite)))
    lens = np.diff(offsets)
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & (lens > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    for n in np.unique(lens[good]):
        at = np.flatnonzero(good & (lens == n))
        yield at, flat[offsets[at][:, None] + np.arange(n)]
