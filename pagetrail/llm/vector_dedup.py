"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed orthogonal matrix and split into low-dimensional blocks. A pair
within squared distance D (2 - 2 cosine) is within D * (block size / dimensions) in one block at
least. So each block is range-joined on its own: a grid over its leading coordinates, as wide as the
budget's root twice, brings pairs within the budget into one cell or two neighbouring ones, and a class
is seen in a neighbouring cell only if it lies in the half towards it. Of the union of candidates every pair is verified by its cosine in double precision, in the first block that
proposes it and there alone, so links are counted without a list of pairs.

Equal vectors are one numbered class with a count. Classes of a label that are many get a grid over
more coordinates; a cell that holds more than `CHUNK` classes all the same is compared chunk by chunk
in several groups. Groups return a row per linked class: how many vectors it links with, and the
smallest class of those it hangs together with there.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or has a
null label or id, links with nothing and is its own component; vectors of different lengths never
link; vectors that share an id count and link each by itself; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm.components import components
from pagetrail.llm.shared import table, written

COSINE, BLOCKS, CHUNK = 0.98, 8, 4000
#: Classes of a label that a grid over one coordinate is enough for; each further one serves GROWTH times as many.
FIRST_GRID, GROWTH, MOST_COORDINATES = 20_000, 4, 4
SLACK = 1e-9


@functools.cache
def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).normal(size=(dims, dims)))[0]


def block_columns(dims: int) -> list[np.ndarray]:
    return [b for b in np.array_split(np.arange(dims), min(BLOCKS, dims)) if len(b)]


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def turned(units: np.ndarray) -> np.ndarray:
    """Rotated vectors; each row's result depends on that row alone, whatever rows are beside it."""
    return np.einsum("ij,jk->ik", units, rotation(units.shape[1]))


def budget(columns: np.ndarray, dims: int, cosine: float) -> float:
    return (2 - 2 * cosine) * len(columns) / dims + SLACK


def cells(rotated: np.ndarray, columns: np.ndarray, width: float, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, place inside it from 0 to 1) by each coordinate."""
    at = rotated[:, columns[:coordinates]] / width
    cell = np.floor(at)
    return cell.astype(np.int64), at - cell


def towards(place: np.ndarray, step: tuple[int, ...]) -> np.ndarray:
    """Whether a class lies in the half of its cell that a step's cell borders on."""
    ways = np.array(step)
    return (((ways <= 0) | (place >= 0.5 - SLACK)) & ((ways >= 0) | (place <= 0.5 + SLACK))).all(axis=1)


def forward(coordinates: int) -> list[tuple[int, ...]]:
    """The cell itself and the half of its neighbours that come after it."""
    grid = np.stack(np.meshgrid(*[[-1, 0, 1]] * coordinates, indexing="ij"), -1).reshape(-1, coordinates)
    zero = (0,) * coordinates
    return [t for t in map(tuple, grid.tolist()) if t >= zero]


def placed(classes: DataFrame, cosine: float, kind: str) -> DataFrame:
    """A row for each block and cell that a class must be seen in; own: the cell is its own; kind: type of a component."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for (dims, coordinates), part in pdf.groupby(["dims", "coordinates"]):
                rotated = turned(unit(np.stack(part["vector"].to_numpy())))
                for b, columns in enumerate(block_columns(dims)):
                    used = min(coordinates, len(columns))
                    at, place = cells(rotated, columns, 2 * math.sqrt(budget(columns, dims, cosine)), used)
                    for step in forward(used):
                        key = np.zeros(len(part), np.int64)
                        for k in range(used):
                            key = key * 65_536 + (at[:, k] + step[k] + 32_768) % 65_536
                        near = towards(place, step)
                        seen = part[near]
                        yield pd.DataFrame({"label": seen["label"], "dims": dims, "block": b, "cell": key[near], "own": not any(step), "class": seen["class"], "copies": seen["copies"], "vector": seen["vector"]})

    return classes.mapInPandas(run, f"label long, dims int, block int, cell long, own boolean, class long, copies long, vector array<{kind}>")


def linked(own: np.ndarray, chunk: np.ndarray, low: int, high: int, block: int, rep: np.ndarray, copies: np.ndarray, vectors: np.ndarray, cosine: float):
    """(rep, root, links) of the classes that link in this task: chunk low against chunk high."""
    dims = vectors.shape[1]
    columns, units = block_columns(dims), unit(vectors)
    rotated = turned(units)
    here = rotated[:, columns[block]]
    square = np.einsum("ij,ij->i", here, here)
    left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    count, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, 1_000_000 // max(1, len(right)))
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        near = square[rows][:, None] + square[right][None, :] - 2 * here[rows] @ here[right].T <= budget(columns[block], dims, cosine) + SLACK
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        keep = (own[i] | own[j]) & ((i < j) if low == high else True)
        for part in range(0, len(i := i[keep]), 200_000):
            a, b = i[part : part + 200_000], (j[keep])[part : part + 200_000]
            gap = (rotated[a] - rotated[b]) ** 2
            fine = gap[:, columns[block]].sum(axis=1) <= budget(columns[block], dims, cosine)
            for earlier in range(block):  # a pair belongs to the first block that proposes it
                fine &= gap[:, columns[earlier]].sum(axis=1) > budget(columns[earlier], dims, cosine)
            a, b = a[fine], b[fine]
            x, y = vectors[a].astype(np.float64), vectors[b].astype(np.float64)
            true = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= cosine
            a, b = a[true], b[true]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
    hit = np.flatnonzero(count)
    least = np.full(len(rep), np.iinfo(np.int64).max)
    roots = np.array([find(i) for i in hit], np.int64)
    np.minimum.at(least, roots, rep[hit])
    return rep[hit], least[roots], count[hit]


def groups_of(batches: Iterator, keys: int) -> Iterator:
    """Tables of the rows that share the first columns; rows come sorted by them."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[:1] = bool(held) and any(c[0] != held[0].column(k)[0].as_py() for k, c in enumerate(columns))
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if n and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def vector_links(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per vector."""
    # single precision travels as such; every computation is in double
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = finite & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    fit = rows.filter("sound").select("vec_id", "label", "vector")

    classes = fit.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumns({"dims": F.size("vector"), "class": F.monotonically_increasing_id()}), "classes")
    sizes = classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    more = F.floor(F.log(float(GROWTH), F.greatest(F.col("n") / FIRST_GRID, F.lit(1.0)))) + 1
    sizes = sizes.select("label", "dims", F.least(more, F.lit(MOST_COORDINATES)).cast("int").alias("coordinates"))
    seen = placed(classes.join(sizes, ["label", "dims"]).select("label", "dims", "coordinates", "class", "copies", "vector"), cosine, kind)

    key = ["label", "dims", "block", "cell"]
    seen = written(seen, "cells")
    full = written(seen.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / chunk)).drop("n"), "full")
    dealt = seen.join(full, key, "left").fillna(1, ["chunks"]).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")))
    # a chunk meets every chunk of its cell, itself included, in a group of their own
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for group in groups_of(batches, 6):
            if len(group) < 2:
                continue
            own, chunks, number, copies = (group.column(c).to_numpy() for c in ("own", "chunk", "class", "copies"))
            dims, block, low, high = (group.column(c)[0].as_py() for c in ("dims", "block", "low", "high"))
            flat = np.concatenate([c.flatten().to_numpy() for c in group.column("vector").chunks])
            found = linked(own, chunks, low, high, block, number, copies, flat.reshape(-1, dims), cosine)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["class", "root", "links"])

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.select(*key, "low", "high", "own", "chunk", "class", "copies", "vector").repartition(n, *key, "low", "high").sortWithinPartitions(*key, "low", "high")
    found = written(grouped.mapInArrow(run, "class long, root long, links long"), "found")

    joined = written(components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))), "joined")
    least = joined.join(classes.select("class", "rep"), F.col("node") == F.col("class")).groupBy("component").agg(F.min("rep").alias("component_id"))
    reached = joined.join(least, "component").select(F.col("node").alias("class"), "component_id")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("label", "vector", "rep", "copies", "class").join(links, "class", "left").join(reached, "class", "left")
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    good = fit.join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_subspace_pigeonhole": op9_subspace_pigeonhole}
#: By brute force: all pairs of a label, then reachability; for small tables.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding AS v, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, CAST(least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) AS BIGINT) AS component_id,
       vec_id <= coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id) AS kept
FROM embeddings
"""
ORACLES = {"op9_subspace_pigeonhole": SQL}
