"""Best-fit packing of token sequences, planned on a histogram of lengths.

One pass counts the tokens of every document and cuts those longer than a sequence. The plan is made
on counts: at most `capacity` lengths with how many pieces have each, best-fit decreasing over those
counts, so its size does not depend on the number of documents. A plan is a list of runs: "the pieces
of length L ranked a to b take sequences s, s+1, ... at offset o". Pieces get their rank within
their length from the task that wrote them plus an offset for each task, and take their slot by a
join of rank and run.

Defined results: null and empty texts are documents of the end id alone; a full-length piece is a
sequence of its own; equal documents are packed like any others; an empty table gives an empty
result; columns besides id and text are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.llm.shared import TOKENIZER_JSON, table, written
from pagetrail.llm.tokens import encoder

CAPACITY, END_ID = 2048, 0
PIECES = "row_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    head = length % capacity or min(length, capacity)
    return [(0, head), *((at, capacity) for at in range(head, length, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, with its rank among the pieces of that length that the same task made."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = end_id.to_bytes(4, "little")
        for batch, flat, ends in words.over(batches, most=4 << 20):
            out, data = [], memoryview(flat.view(np.uint8))
            for row_id, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n = b - a + 1  # with the end id
                for piece, (start, length) in enumerate(cut(n, capacity)):
                    crc = zlib.crc32(data[4 * (a + start) : 4 * min(a + start + length, b)])
                    out.append((row_id, piece, start, length, crc if start + length < n else zlib.crc32(end, crc), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths, groups of like sequences at a time.

    Returns runs (length, first rank, last rank + 1, sequence of the first, offset). Longer pieces
    come first; each goes to the fullest sequences that still take it. What is left open is kept by
    free space as groups (first sequence, how many), so that a group is split once a step at most.
    """
    runs, opened, spaces, sequences = [], {}, [], 0
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                fill = capacity // length  # as nothing open takes this length, new sequences fill up with it
                full, rest = divmod(left, fill)
                for k in range(fill):
                    if n := full + (k < rest):
                        runs.append((length, rank, rank + n, sequences, k * length))
                        rank += n
                _open(opened, spaces, capacity - fill * length, sequences, full)
                _open(opened, spaces, capacity - rest * length, sequences + full, int(rest > 0))
                sequences, left = sequences + full + (rest > 0), 0
                continue
            space = spaces[at]
            first, many = opened[space].pop()
            if not opened[space]:
                del opened[space], spaces[at]
            n = min(many, left)
            runs.append((length, rank, rank + n, first, capacity - space))
            rank, left = rank + n, left - n
            if many > n:
                _open(opened, spaces, space, first + n, many - n)
            _open(opened, spaces, space - length, first, n)
    return runs


def _open(opened: dict[int, list], spaces: list[int], space: int, first: int, many: int) -> None:
    if space > 0 and many:
        if space not in opened:
            bisect.insort(spaces, space)
            opened[space] = []
        opened[space].append((first, many))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece."""
    spark = docs.sparkSession
    made = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")

    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    by_task = written(by_task, "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.createDataFrame(best_fit(counts, capacity), "length long, rank_from long, rank_to long, sequence_from long, offset long")

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # a row for each length and task: as many tasks would make a large broadcast, both sides are sorted
    ranked = made.join(offsets.hint("merge"), ["length", "task"]).withColumn("rank", F.col("task_rank") + F.col("before"))
    # a length has a few runs, whatever the number of pieces: the plan is bounded by the capacity
    fits = [ranked["length"] == plan["length"], F.col("rank") >= F.col("rank_from"), F.col("rank") < F.col("rank_to")]
    placed = ranked.join(F.broadcast(plan), fits)
    return placed.select(
        F.col("row_id").alias("doc_id"), "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset",
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_JSON))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES: dict[str, str] = {}
