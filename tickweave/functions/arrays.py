"""Array helpers of tasks that keep many running values at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def group_starts(keys: list, before) -> np.ndarray:
    """For each row the row of this batch at which its group began, -1 where it goes on from the batch before (whose last key was `before`). Equal keys are adjacent."""
    fresh = np.array([k != b for k, b in zip(keys, [before, *keys[:-1]], strict=True)], bool)
    return np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))


def codes(column: pa.Array) -> tuple[list, np.ndarray]:
    """The different values of a column, null among them, and of each row the place of its own."""
    found = column.dictionary_encode(null_encoding="encode")
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)


def sorted_starts(batch: pa.RecordBatch, keys: list[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """group_starts of the rows by the named columns, and the last row's key."""
    fresh = np.zeros(batch.num_rows, bool)
    for k in keys:
        own = codes(batch.column(k))[1]
        fresh[1:] |= own[1:] != own[:-1]
    ends = [tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, batch.num_rows - 1)]
    fresh[0] = ends[0] != before
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), -1)), ends[1]


def running(values: np.ndarray, start: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Running sums down the rows within groups; carry: the sums of the group that goes on."""
    total = np.cumsum(values, 0)
    base = np.where((start >= 0)[:, None], (total - values)[np.maximum(start, 0)], -carry)
    return total - base
