"""The invite tree: children, depth, descendants, deletion.

Defined results: a parent that is null, 0 or gone makes a root; users on a cycle have no depth and end
a walk; repeated ids count once in walks, by the nearest of their parents; an empty table gives no rows and 0 levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.sources.scratch import written


def child_counts(users: DataFrame) -> DataFrame:
    n = users.filter("parent_id <> 0").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return users.select("id").join(n, "id", "left").select("id", F.coalesce("children", F.lit(0)).alias("children"))


def attached(users: DataFrame) -> DataFrame:
    """id, parent: the parent where it exists, else null (a root)."""
    parents = users.select(F.col("id").alias("parent"))
    return users.select("id", "parent_id").join(parents, F.col("parent_id") == F.col("parent"), "left").select("id", "parent")


def _steps_up(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """id, depth: the steps from each id up edges(id, parent) to the nearest of stops(id), these included.

    Pointer doubling: round k holds, for ids not done, the user 2^k steps up, and finds all depths from 2^k
    to 2^(k+1) - 1 by one join. A round that finds none has found all there are, cycles or not.
    """
    found = stops = written(stops.select("id", F.lit(0).alias("depth")).distinct(), "depths")
    ups = written(edges.join(stops, "id", "left_anti").select("id", F.col("parent").alias("up")).distinct(), "ups")
    step = 1
    while True:
        above = found.select(F.col("id").alias("up"), F.lit(None).cast("long").alias("next"), "depth")
        above = above.unionByName(ups.select(F.col("id").alias("up"), F.col("up").alias("next"), F.lit(None).cast("int").alias("depth")))
        met = ups.join(above, "up").groupBy("id", "next").agg((F.min("depth") + step).alias("depth"))
        met = written(met, "met")
        new = met.filter("depth IS NOT NULL").select("id", "depth")
        if new.limit(1).count() == 0:
            return found.groupBy("id").agg(F.min("depth").alias("depth"))
        found, ups, step = found.unionByName(new), met.filter("depth IS NULL").select("id", F.col("next").alias("up")), 2 * step


def depths(users: DataFrame) -> DataFrame:
    """id, depth; roots have no existing parent and depth 0. Users on a cycle have no depth."""
    edges = written(attached(users), "tree")
    return _steps_up(edges.filter("parent IS NOT NULL"), edges.filter("parent IS NULL"))


def descendants(users: DataFrame, ids: DataFrame) -> DataFrame:
    """id, depth below the nearest of ids(id), these included."""
    return _steps_up(users.filter("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("parent")), ids)


def tree_stats(users: DataFrame) -> DataFrame:
    """total, average_invites (links to a parent per user, 1 decimal; 0 when empty), levels."""
    links = F.sum(F.when(F.col("parent_id") != 0, 1).otherwise(0))
    totals = users.agg(F.count(F.lit(1)).alias("total"), F.round(F.coalesce(links / F.count(F.lit(1)), F.lit(0.0)), 1).alias("average_invites"))
    deepest = depths(users).agg((F.coalesce(F.max("depth"), F.lit(-1)) + 1).alias("levels"))
    return totals.crossJoin(F.broadcast(deepest))  # one row each


def delete_users(users: DataFrame, sessions: DataFrame, ids: DataFrame, recursive: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, sessions, one row with n): ids, with their descendants if recursive, are gone; children left behind become roots."""
    gone = descendants(users, ids).select("id") if recursive else ids.select("id").distinct()
    gone = written(gone.join(users, "id", "left_semi"), "gone")
    parent = gone.select(F.col("id").alias("__gone"))
    left = users.join(gone, "id", "left_anti").join(parent, F.col("parent_id") == F.col("__gone"), "left")
    left = left.withColumn("parent_id", F.when(F.col("__gone").isNull(), F.col("parent_id"))).drop("__gone").select(*users.columns)
    return left, sessions.join(gone.select(F.col("id").alias("user_id")), "user_id", "left_anti").select(*sessions.columns), gone.agg(F.count(F.lit(1)).alias("n"))
