"""Words of many texts at once: one pass over their bytes, each distinct word once."""

from __future__ import annotations

import numpy as np

from pagetrail.llm.hashing import prefix_sums, range_hashes

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def byte_set(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


class Words:
    """Words of binary texts: `texts` says of which, `code` which entry of `distinct`, `start` where in `data`.

    Upper-case ASCII letters are lowered. apart: bytes between words. Between two texts stands a line break.
    """

    def __init__(self, texts: list[bytes], apart: np.ndarray):
        import pyarrow as pa

        raw = b"\n".join(texts).translate(LOWER)
        self.data = np.frombuffer(raw, np.uint8)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = apart[self.data]
        gap[1:-1][np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64) - 1] = True
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, ends = edges[::2], edges[1::2]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.texts = np.searchsorted(np.cumsum(sizes) - sizes, self.start, "right") - 1
        offsets = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(ends - self.start, out=offsets[1:])
        kept = np.ascontiguousarray(self.data[~gap[1:-1]])
        all_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        coded = all_.dictionary_encode()
        self.code, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word; others may share it."""
        if not len(self.distinct):
            return np.zeros(0, np.uint64)
        _, offsets, data = self.distinct.buffers()
        ends = np.frombuffer(offsets, np.int64)[self.distinct.offset :][: len(self.distinct) + 1]
        return range_hashes(prefix_sums(np.frombuffer(data, np.uint8)[: ends[-1]]), ends[:-1], ends[1:])

    def strings(self, codes: np.ndarray):
        """Those distinct words as an Arrow array of strings."""
        import pyarrow as pa

        found = self.distinct.take(pa.array(codes))
        return pa.Array.from_buffers(pa.large_string(), len(found), found.buffers(), found.null_count, found.offset).cast(pa.string(), safe=False)


def binary_texts(column) -> list[bytes]:
    """The texts of a string column as UTF-8; null counts as empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
