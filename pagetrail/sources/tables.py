"""Readers and writers.

Defined results: files that lack a column of the schema give nulls there; null contents have no digest and
are not stored, those with a null id are; contents that repeat are stored once; a query without hits has an
empty list of results where the queries are given, else no row; texts that are null, empty or do not parse are dead letters; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail import schemas
from pagetrail.operators import blocks, search
from pagetrail.sources import increments, versions
from pagetrail.sources.contents import read_contents  # noqa: F401
from pagetrail.sources.scratch import shuffles_removed


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_captures(spark: SparkSession, path: str, form: str = "parquet", schema: str = schemas.CAPTURES) -> DataFrame:
    return spark.read.schema(schema).format(form).load(path)


def read_capture_stream(spark: SparkSession, path: str, form: str = "parquet", files: int = 1, schema: str = schemas.CAPTURES) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def write_index(postings: DataFrame, path: str, buckets: int | None = None, pages: DataFrame | None = None, size: int = blocks.PAGES) -> int:
    """A new version of the index at path: postings by field, terms hashed into files and sorted inside, and their statistics.

    pages(id, timestamp): postings are also written in blocks of `size` pages with bounds, for the best hits of a query.
    Readers see it once its last table is complete; those that opened an earlier version keep it.
    """
    spark = postings.sparkSession
    number = max(versions.numbers(spark, path, "version-", "fields"), default=-1) + 1
    at, buckets = f"{path}/version-{number}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        versions.columns(postings, at, "postings")
        placed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
        placed.repartition(buckets, "field", "bucket").sortWithinPartitions("field", "term", "id").drop("bucket").write.mode("overwrite").partitionBy("field").parquet(f"{at}/postings")
        stored = versions.opened(spark, at, "postings")
        search.term_stats(stored).write.mode("overwrite").parquet(f"{at}/terms")
        search.doc_stats(stored).write.mode("overwrite").parquet(f"{at}/docs")
        docs = spark.read.parquet(f"{at}/docs")
        if pages is not None:
            blocks.page_ranges(docs, pages, size).write.mode("overwrite").parquet(f"{at}/ranges")
            made = blocks.build_blocks(stored, docs, search.field_stats(docs), spark.read.parquet(f"{at}/ranges"))
            versions.columns(made, at, "blocks")
            placed = made.withColumn("bucket", F.pmod(F.xxhash64("term", "range"), F.lit(buckets)))
            placed.repartition(buckets, "field", "bucket").sortWithinPartitions("field", "term", "range").drop("bucket").write.mode("overwrite").partitionBy("field").parquet(f"{at}/blocks")
        search.field_stats(docs).write.mode("overwrite").parquet(f"{at}/fields")
    return number


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(postings, statistics for search, blocks among them where they were written) of the newest complete version and its changes."""
    return increments.opened(spark, versions.newest(spark, path))


def compact(spark: SparkSession, path: str, pages: DataFrame | None = None, keep: int = 1, **how) -> int:
    """A new version without changes, as write_index writes it; only the `keep` newest versions stay."""
    number = write_index(open_index(spark, path)[0], path, pages=pages, **how)
    increments.remove_versions(spark, path, keep)
    return number


def store_contents(contents: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """hash, size, prefix, content of what is new: one of each digest that is not in stored(hash) yet.

    contents: content, whatever else. Write the result partitioned by `prefix`.
    """
    new = contents.filter("content IS NOT NULL").select("content", F.sha2("content", 256).alias("hash"))
    if stored is not None:
        new = new.join(stored.select("hash"), "hash", "left_anti")
    return new.dropDuplicates(["hash"]).select("hash", F.octet_length("content").cast("long").alias("size"), F.substring("hash", 1, 2).alias("prefix"), "content")


def to_result_json(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, result: the hits of each query (query_id, rank, score, title, description, timestamp, url) as one JSON text."""
    hit = F.struct("rank", "score", F.struct("title", "description", "timestamp", "url").alias("doc"))
    found = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    if queries is not None:
        found = queries.select("query_id").distinct().join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)))
    shown = F.transform("hits", lambda h: F.struct(h["score"].alias("score"), h["doc"].alias("doc")))
    return found.select("query_id", F.to_json(F.struct(shown.alias("search_results"))).alias("result"))


def parse_annotations(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an `annotation` struct, rows whose text does not parse)."""
    kind = "title string, direct_keywords array<string>, related_keywords array<string>, description string, _corrupt string"
    parsed = df.withColumn("annotation", F.from_json(F.col(col), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("annotation").isNull() | F.col("annotation._corrupt").isNotNull()
    good = parsed.filter(~bad).withColumn("annotation", F.col("annotation").dropFields("_corrupt"))
    return good, parsed.filter(bad).drop("annotation")
