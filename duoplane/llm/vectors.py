"""Vectors in Arrow batches as numpy matrices, one for each length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector: the rows of the batch and their entries as doubles. Vectors that are null or hold null or
    non-finite entries are left out; so are empty ones."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is a NaN here
    starts = np.cumsum(lengths) - lengths
    bad = np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(entries)]
    there[bad] = False
    for d in np.unique(lengths[there & (lengths > 0)]).tolist():
        rows = np.flatnonzero(there & (lengths == d))
        yield rows, entries[starts[rows][:, None] + np.arange(d)]


def binary(matrix: np.ndarray) -> list[bytes]:
    """Each row of a matrix as bytes."""
    held, width = np.ascontiguousarray(matrix).tobytes(), matrix.dtype.itemsize * matrix.shape[1]
    return [held[i : i + width] for i in range(0, len(held), width)]
