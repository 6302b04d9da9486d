"""Upserts, deletes and folds of the capture log.

Defined results: a null URL is a URL of its own in `latest_by_url`, `upsert` and `apply_log` and matches
nothing in deletes and lookups; of rows with one URL and seq any may stay, a null seq loses to any other and
stays where there is none; repeated rows count once; empty tables give empty results; columns are kept in
the order of the first table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_url(captures: DataFrame) -> DataFrame:
    """The row of largest seq of each URL; a much captured URL is reduced before the shuffle."""
    row = F.struct(*[captures[c] for c in captures.columns])
    newest = F.struct(F.col("seq").isNotNull(), F.col("seq"))  # never null, so that no URL is lost
    return captures.groupBy("url").agg(F.max_by(row, newest).alias("row")).select("row.*")


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """index with the latest of each URL in new in place of its own row."""
    latest = latest_by_url(new)
    replaced = latest.select(F.col("url").alias("__url"))
    return index.join(replaced, F.col("url").eqNullSafe(F.col("__url")), "left_anti").unionByName(latest).select(*index.columns)


def apply_log(log: DataFrame) -> DataFrame:
    """Pages whose last operation is `index`."""
    return latest_by_url(log).filter("op = 'index'")


def delete_by_url(index: DataFrame, urls: DataFrame, user_id: int | None = None) -> DataFrame:
    """index without those URLs; with a user_id, only that user's pages can be deleted."""
    gone = urls.select(F.col("url").alias("gone")).distinct()
    match = index["url"] == gone["gone"]
    return index.join(gone, match & (index["user_id"] == user_id) if user_id is not None else match, "left_anti")


def recent_captures(log: DataFrame, k: int = 15) -> DataFrame:
    """The newest captures of the log, again where a page came again; deletes take nothing away."""
    return log.filter("op = 'index'").orderBy(F.desc("seq")).limit(k)


def get_by_url(index: DataFrame, urls: DataFrame) -> DataFrame:
    return index.join(urls.select("url").distinct(), "url", "left_semi")
