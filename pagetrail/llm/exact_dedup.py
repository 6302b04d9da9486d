"""Exact deduplication with a heavy-hitter split, DataFrame functions only.

A frequent-items sketch of the Misra-Gries family (`approx_top_k`) finds the digests that may be
frequent. Their true group sizes and winners are computed by a partially aggregated count over the
candidates alone, and go as a broadcast of at most `heavy` rows to the map side, so that rows of a
hot group are never shuffled. All other digests, none of which can hold more than a small share of
the rows, go through one ordinary shuffle.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays
(null ids are smaller than any other); rows that repeat both id and text of the winner stay with
it; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.llm.bloom import joined_few
from pagetrail.llm.shared import table, written

#: Candidates kept from the sketch, and the counters it may use: both bound what is broadcast.
HEAVY, COUNTERS = 256, 8192


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, digest (binary SHA-256 of the text), keep_id, group_size, kept."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = written(docs.select(F.col(id_col).alias("id"), digest.alias("digest")), "digests")

    # xxhash64 keeps the sketch's items at eight bytes; a collision costs a needless candidate only
    sketched = rows.agg(F.expr(f"approx_top_k(xxhash64(digest), {heavy}, {counters})").alias("top"))
    frequent = sketched.select(F.explode("top").alias("t")).filter("t.count > 1").select(F.col("t.item").alias("h")).filter("h IS NOT NULL")
    keyed = rows.withColumn("h", F.xxhash64("digest"))
    winners = (
        keyed.join(F.broadcast(frequent), "h", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = written(winners, "winners")

    marked = rows.join(F.broadcast(winners), "digest", "left")
    hot = marked.filter("group_size IS NOT NULL")
    rest = marked.filter("group_size IS NULL").select("id", "digest")
    same = Window.partitionBy("digest")
    rest = rest.select("id", "digest", F.max("id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"))
    return hot.select("id", "digest", "keep_id", "group_size").unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with their own columns.

    Dropped rows leave by an anti join on id and digest; a row without an id stays only where its
    whole group has none.
    """
    out = decisions(docs, id_col, text_col, **how).filter(~F.col("kept")).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    keyed = docs.withColumns({"__id": F.col(id_col), "__digest": digest})
    return joined_few(keyed, written(out.distinct(), "dropped"), ["__id", "__digest"], "left_anti").select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decisions(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": SQL}
