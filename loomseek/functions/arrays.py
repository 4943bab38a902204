"""Arrow string arrays as bytes and offsets, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; bounds the memory of a Python worker, whatever Spark's batches hold.
SLICE_BYTES = 1 << 20


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls and the offsets of its values, the first 0."""
    if pa.types.is_large_string(col.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    _, offs, data = col.buffers()
    if offs is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, kind, len(col) + 1, col.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges (i, j) of rows whose sizes add up to about ``most``, one row at least."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield i, j
        i = j


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (i, j) of rows with about ``most`` bytes of text each, one row at least."""
    return cuts(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), most)
