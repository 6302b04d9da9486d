"""Batches of texts in Python tasks, bounded in bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np

#: Bytes of text that a task works on at a time; one longer text is a piece of its own.
PIECE_BYTES = 8 << 20


def pieces(batches: Iterator, column: int, most: int = PIECE_BYTES) -> Iterator:
    """The record batches, cut so that a string column has about `most` bytes in each; memory is given back at the end."""
    import pyarrow.compute as pc

    try:
        for batch in batches:
            sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(sizes) // most
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(sizes) else []
            for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
                yield batch.slice(a, b - a)
    finally:
        give_back()


def give_back() -> None:
    """Free memory of this worker goes back to the machine; workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
