"""Content-addressed files.

Defined results: files with a null hash are one content; of uploads with one hash the smallest id is
the first, a null id comes after all others, and rows that repeat the first one are first each; a null is_public counts as no metadata in access;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.sources.scratch import written

#: Hashes whose uploads are joined without a shuffle.
HEAVY = 200


def frequent(rows: DataFrame, most: int = HEAVY, col: str = "hash") -> list[str]:
    """Values that a frequent-items sketch holds: every one of more than about one row in `most` is among them."""
    row = rows.filter(F.col(col).isNotNull()).agg(F.expr(f"approx_top_k({col}, {most}, {most * 8})").alias("top")).first()
    return [r.item for r in row.top or []]


def file_dedup(files: DataFrame, most: int = HEAVY) -> DataFrame:
    """Every upload with the id and name of the first one of its hash, which is what is returned for it.

    The first ones of frequent hashes, and of the null hash, are broadcast, `most` + 1 rows at most, so their
    uploads stay where they are read; only the others are shuffled.
    """
    first = files.groupBy(F.col("hash").alias("__hash")).agg(F.min(F.struct(F.col("id").isNull(), "id", "filename")).alias("stored"))
    first = written(first, "first")
    few = frequent(files, most)
    heavy = F.col("__hash").isNull() | F.col("__hash").isin(few)
    hot = F.col("hash").isNull() | F.col("hash").isin(few)
    same = F.col("hash").eqNullSafe(F.col("__hash"))
    rows = files.select("id", "hash")
    joined = rows.filter(hot).join(F.broadcast(first.filter(heavy)), same)
    joined = joined.unionByName(rows.filter(~hot).join(first.filter(~heavy), F.col("hash") == F.col("__hash")))
    return joined.select("id", "hash", F.col("stored.id").alias("stored_id"), F.col("stored.filename").alias("stored_filename"), F.col("id").eqNullSafe(F.col("stored.id")).alias("is_first"))


def first_files(files: DataFrame) -> DataFrame:
    """The first upload of each hash, by partial aggregates."""
    return files.groupBy("hash").agg(F.min_by(F.struct(*[files[c] for c in files.columns]), F.struct(F.col("id").isNull(), F.col("id"))).alias("row")).select("row.*")


def add_files(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored and the first upload of each hash of new that is not there yet."""
    known = stored.select(F.col("hash").alias("__hash"))
    return stored.unionByName(first_files(new).join(known, F.col("hash").eqNullSafe(F.col("__hash")), "left_anti").select(*stored.columns))


def visible_files(files: DataFrame, public_only: bool) -> DataFrame:
    return files.filter("is_public = 1") if public_only else files


def file_access(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests(request_id, file_id, valid) with `decision`: no_metadata, private or ok."""
    known = files.select(F.col("id").alias("file_id"), "is_public")
    decision = F.when(F.col("is_public").isNull(), "no_metadata").when((F.col("is_public") == 0) & ~F.col("valid"), "private").otherwise("ok")
    return requests.join(known, "file_id", "left").withColumn("decision", decision)
