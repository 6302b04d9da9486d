"""Token-id files: ids coded by context mixing in independent, checksummed blocks.

File: MAGIC; groups, each its prior (zlib: distinct ids and levels of frequency) and its coded blocks; a
zlib-packed JSON directory (groups, blocks with size, checksums of ids and of coded bytes; documents
with id and number of tokens); its length and crc32. A block is decoded from itself and its group's
prior (`mixing.py`). A file holds documents of one range of ids in ascending order and ends after
about `FILE` tokens, so files in the order of part and number give the whole corpus.

Defined results: null and empty texts are the end id alone; null ids come first; rows that share an
id are ordered by text; an id of a token over 65,535 is an error when it is written; an empty table gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.llm.batches import give_back
from pagetrail.llm.mixing import Prior, decode, encode, levels_of
from pagetrail.llm.shared import TOKENIZER_JSON, fresh_path, table, written
from pagetrail.llm.tokens import encoder
from pagetrail.llm.warc_zip import opened

MAGIC, END_ID = b"TOKIDS02", 0
#: Lanes that a group should have, most tokens of a block, of a group (bounds the memory) and of a file.
LANES, MOST, GROUP, FILE = 1024, 2048, 1 << 23, 1 << 26


def block_size(n: int) -> int:
    """Tokens of a block in a group of n: a power of two that gives about LANES lanes."""
    return min(MOST, max(512, 1 << (max(1, n // LANES) - 1).bit_length()))


def packed_prior(ids: np.ndarray) -> bytes:
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    return zlib.compress(np.diff(known, prepend=0).astype("<u2").tobytes() + levels_of(counts[known]).tobytes(), 9)


def unpacked_prior(data: bytes) -> Prior:
    raw = zlib.decompress(data)
    n = len(raw) // 3
    return Prior(np.cumsum(np.frombuffer(raw, "<u2", n), dtype=np.int64), np.frombuffer(raw, np.uint8, n, 2 * n))


class Writer:
    """Writes groups as they fill up; close() adds the directory."""

    def __init__(self, f):
        self.f, self.at, self.groups, self.ids, self.sizes, self.waiting, self.size, self.tokens = f, 0, [], [], [], [], 0, 0
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.f.write(data)
        self.at += len(data)

    def add(self, doc_ids: list[int | None], sizes: list[int], tokens: np.ndarray) -> None:
        """Documents with so many of the tokens each."""
        self.ids += doc_ids
        self.sizes += sizes
        self.waiting.append(tokens)
        self.size += len(tokens)
        self.tokens += len(tokens)
        while self.size >= GROUP:
            self.flush(GROUP)

    def flush(self, most: int) -> None:
        joined = np.concatenate([np.zeros(0, np.uint32), *self.waiting])
        ids, rest = joined[:most].astype("<u4"), joined[most:]
        self.waiting, self.size = [rest.copy()], len(rest)
        if len(ids):
            if ids.max() > 0xFFFF:
                raise ValueError("an id takes more than 16 bits")
            block, prior = block_size(len(ids)), packed_prior(ids)
            coded = encode(ids, block, unpacked_prior(prior))
            sums = [zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) for i in range(len(coded))]
            self.groups.append({"offset": self.at, "tokens": len(ids), "block": block, "prior": len(prior), "prior_crc32": zlib.crc32(prior), "sizes": [len(c) for c in coded], "ids_crc32": sums, "crc32": [zlib.crc32(c) for c in coded]})
            self.put(b"".join([prior, *coded]))

    def close(self) -> None:
        self.flush(GROUP)
        packed = zlib.compress(json.dumps({"groups": self.groups, "docs": [self.ids, self.sizes]}).encode())
        self.put(packed + struct.pack("<II", len(packed), zlib.crc32(packed)))


def read_file(f, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a file; wrong checksums are errors."""
    length, crc = struct.unpack("<II", f.read_at(8, size - 8))
    packed = f.read_at(length, size - 8 - length)
    if f.read_at(len(MAGIC), 0) != MAGIC or zlib.crc32(packed) != crc:
        raise ValueError("broken token file")
    directory = json.loads(zlib.decompress(packed))
    docs, parts, have = zip(*directory["docs"], strict=True), [], 0
    doc_id, want = next(docs, (None, None))
    for group in directory["groups"]:
        raw, at, coded = f.read_at(group["prior"] + sum(group["sizes"]), group["offset"]), group["prior"], []
        if zlib.crc32(raw[:at]) != group["prior_crc32"]:
            raise ValueError("broken prior")
        prior = unpacked_prior(raw[:at])
        for n, crc in zip(group["sizes"], group["crc32"], strict=True):
            coded.append(raw[at : at + n])
            if zlib.crc32(coded[-1]) != crc:
                raise ValueError("broken block")
            at += n
        ids, block = decode(coded, group["tokens"], group["block"], prior).astype("<u4"), group["block"]
        for i, crc in enumerate(group["ids_crc32"]):
            if zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) != crc:
                raise ValueError("a block does not decode to its ids")
        at = 0
        while want is not None and have + len(ids) - at >= want:
            take = want - have
            yield doc_id, np.concatenate([*parts, ids[at : at + take]])
            parts, have, at = [], 0, at + take
            doc_id, want = next(docs, (None, None))
        if at < len(ids):
            parts.append(ids[at:])
            have += len(ids) - at


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes files, each for a range of ids; the manifest: part, number, uri, tokens, documents, bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, number, writer, uri = encoder(tokenizer), 0, None, ""

        def closed():
            writer.close()
            writer.f.close()
            columns = {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "number": pa.array([number], pa.int32()), "uri": [uri]}
            return pa.RecordBatch.from_pydict(columns | {k: pa.array([v], pa.int64()) for k, v in (("tokens", writer.tokens), ("documents", len(writer.ids)), ("bytes", writer.at))})

        for piece, ids, ends in words.over(batches):
            if writer is None:
                uri = f"{folder}/{uuid.uuid4().hex}.tokens"
                fs, path = opened(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                writer = Writer(fs.open_output_stream(path))
            writer.add(piece.column(0).to_pylist(), (np.diff(ends) + 1).tolist(), np.insert(ids, ends[1:], end_id))
            if writer.tokens >= FILE:
                yield closed()
                writer, number = None, number + 1
        if writer:
            yield closed()
        give_back()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(run, "part int, number int, uri string, tokens long, documents long, bytes long")


def read_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids): a row per document, from the files alone."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = written(manifest.select("uri", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")), "placed")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = opened(uri)
                out = []

                def made():
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    out.clear()
                    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

                with fs.open_input_file(path) as f:
                    for doc_id, ids in read_file(f, f.size()):
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None))
                        start += len(ids)
                        if len(out) >= 2000:
                            yield made()
                if out:
                    yield made()
        give_back()

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_files(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), public_tokenizers.path(TOKENIZER_JSON))
    return read_files(written(files, "manifest")).drop("ids")


QUERIES = {"op5_context_mixing": op5_context_mixing}
ORACLES: dict[str, str] = {}
