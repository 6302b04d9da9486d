"""Whole numbers in as few bytes as they need, many at once."""

from __future__ import annotations

import numpy as np


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, lowest first, the last byte of a value below 128: (bytes, where each value begins and the end)."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        more = values >= 1 << 7 * k
        if not more.any():
            break
        size += more
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[:-1][some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, at


def unpacked(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)
