"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Within a pre-token, adjacent parts that form a ranked token wait in buckets, one per merge rank, that
hold the places of the left parts in a linked list. Three levels of bitmaps say which buckets are in
use, so that find-first-set gives the lowest rank in three steps whatever the length; an entry whose
parts have since been merged away is stale and skipped when it comes up. A merge takes a few steps,
which suits pre-tokens of any length.

Texts are split by the pattern, after Arrow has cut them into segments that the pattern never joins;
each distinct segment of a piece is merged once.

Defined results: null text counts as empty, which has no ids; special tokens are ordinary text; equal
texts give equal ids; an empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm.shared import TOKENIZER_RANKS, table
from pagetrail.llm.tokens import REMEMBERED, Segments

_CODECS: dict[tuple[str, str], "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: always the leftmost pair of the lowest rank is merged next."""
    if piece in ranks:
        return [ranks[piece]]
    n, rank_of = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [-1] * n  # rank of the pair that starts here, -1 for none
    top, middle, low, buckets = 0, {}, {}, {}
    fresh = [(rank, i) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    while True:
        for rank, i in fresh:
            waiting[i] = rank
            if rank in buckets:
                heappush(buckets[rank], i)
                continue
            buckets[rank] = [i]
            b = rank >> 6
            if b in low:
                low[b] |= 1 << (rank & 63)
                continue
            low[b] = 1 << (rank & 63)
            a = b >> 6
            middle[a] = middle.get(a, 0) | 1 << (b & 63)
            top |= 1 << a
        if not top:
            break
        a = (top & -top).bit_length() - 1
        word = middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            word &= word - 1
            if word:
                low[b] = word
            else:
                del low[b]
                middle[a] &= middle[a] - 1
                if not middle[a]:
                    top &= top - 1
        fresh = []
        if waiting[i] != rank:
            continue  # stale
        j = after[i]
        k = after[j]
        waiting[i] = waiting[j] = -1
        after[i] = k
        if k < n:
            before[k] = i
            if (rank := rank_of(piece[i : after[k]])) is not None:
                fresh.append((rank, i))
        p = before[i]
        if p >= 0:
            waiting[p] = -1
            if (rank := rank_of(piece[p:k])) is not None:
                fresh.append((rank, p))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec(Segments):
    """ids() and many() encode; decode() and decimal() give the strings of ids, one after the other."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import pyarrow as pa
        import regex

        super().__init__(remembered)
        self.ranks, self.pieces = read_ranks(path), regex.compile(pattern).findall
        strings = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            strings[rank] = token
        self.strings, self.decimals = pa.array(strings, pa.large_binary()), pa.array([b"%d " % k for k in range(len(strings))], pa.large_binary())

    def many(self, segments: list[bytes]) -> list[bytes]:
        out = []
        for s in segments:
            ids = array("I")
            for piece in self.pieces(s.decode("utf-8", "replace")):
                ids.extend(merged(piece.encode(), self.ranks))
            out.append(ids.tobytes())
        return out

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(bytes of all ids, where those of each begin and the last one's end)."""
        return spelled(ids, self.strings)

    def decimal(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Decimal ids, a space after each."""
        return spelled(ids, self.decimals)


def spelled(ids: np.ndarray, strings) -> tuple[memoryview, np.ndarray]:
    import pyarrow as pa

    taken = strings.take(pa.array(ids))
    return memoryview(taken.buffers()[2] or b""), np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; it lives as long as the worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of every text as an array."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(path, pattern)
        for piece, ids, ends in own.over(batches):
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: what encoded() ids stand for."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(path, pattern)
        for batch in batches:
            out = [bytes(own.decode(np.array(x or [], np.uint32))[0]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of encoding and decoding, in one pass."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(path, pattern)
        for piece, ids, ends in own.over(batches):
            (text, text_at), (said, said_at) = own.decode(ids), own.decimal(ids)
            out = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                decimals = said[said_at[a] : max(said_at[a], said_at[b] - 1)]
                out.append((b - a, hashlib.sha256(decimals).hexdigest(), hashlib.sha256(text[text_at[a] : text_at[b]]).hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_RANKS), public_tokenizers.PATTERN)


QUERIES = {"op7_bpe_bitmap": op7_bpe_bitmap}
ORACLES: dict[str, str] = {}
