"""Derived inputs of the registered queries; the oracle SQL builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import scalars as S
from pagetrail.operators import pages as P
from pagetrail.operators.changes import latest_by_url
from pagetrail.operators.partners import keyword_partners
from pagetrail.sources import versions
from pagetrail.sources.scratch import fresh_path, written

AS_OF, LOCAL = 1_705_276_800, "host0"
HOSTS = ("host0", "host1", "host2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", S.epoch_seconds(F.col("ts")))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.agg(F.count(F.lit(1)).alias("n"))  # one row
    e = events(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("page_id", F.col("event_id") % F.col("n"))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("index")
    return e.select(F.col("event_id").alias("seq"), "page_id", "user_id", F.col("at").alias("ts"), op.alias("op")).join(pages, "page_id").select("seq", "page_id", "url", "user_id", "ts", "op")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    counter = F.when(k % 5 == 0, None).otherwise((k % 3).cast("int"))
    return table(spark, sf_dir, "customer").select(
        (k + 1).alias("id"), F.floor((k + 1) / 4).cast("long").alias("parent_id"), F.concat(F.lit("u"), (k + 1).cast("string")).alias("username"),
        (F.lit(1_704_067_200) + k * 3600).cast("long").alias("creation_datetime"), F.col("c_name").alias("secret"), F.col("c_mktsegment").alias("invite_secret"), counter.alias("invite_counter"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type = 'signup'")
    host = F.concat(F.lit("host"), (F.col("event_id") % 3).cast("string"))
    return e.select(F.sha2(F.col("event_id").cast("string"), 256).alias("key"), host.alias("host"), "user_id", F.col("at").alias("creation_datetime"), (F.col("at") + 86_400).alias("expires_at_datetime"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.col("event_id") - 1
    key = F.concat(F.sha2(before.cast("string"), 256), F.lit("@host"), (before % 4).cast("string"))
    return events(spark, sf_dir).filter("event_type = 'click'").select(F.col("event_id").alias("request_id"), "user_id", F.col("at").alias("ts"), key.alias("session_key"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("filename"),
        F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 2).cast("int").alias("is_public"), F.col("text").cast("binary").alias("content"),
    )


def hosts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HOSTS], "host string")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extract_text(table(spark, sf_dir, "pages"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per URL, the page with the largest id: id, url, title, description, timestamp."""
    pages = latest_by_url(extracted(spark, sf_dir).withColumn("seq", F.col("page_id")))
    return pages.select(S.page_id(F.col("url")).alias("id"), "page_id", "url", P.title_choice(F.col("title"), F.col("h1"), F.lit(None).cast("string")).alias("title"), P.description(F.col("body")).alias("description"), "body", F.lit(1_704_067_200).cast("long").alias("base")).withColumn("timestamp", F.col("base") + F.col("page_id") * 60).drop("base")


def corpus(idx: DataFrame, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the keywords of pages rest on, written: counts (terms of each page), terms, direct, partners."""
    counts = written(P.term_counts(idx, "id", "body"), "counts") if counts is None else counts
    terms = written(P.corpus_terms(counts, idx), "terms")
    direct = written(P.weighted_terms(counts, terms), "direct")
    return {"counts": counts, "terms": terms, "direct": direct, "partners": written(keyword_partners(direct), "partners")}


def index_and_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """index() without the bodies, written, and its corpus(); the bodies leave the disk once their terms are counted."""
    at = fresh_path(spark, "bodies")
    whole = written(index(spark, sf_dir), "index", at)
    idx, counts = written(whole.drop("body"), "index"), written(P.term_counts(whole, "id", "body"), "counts")
    versions.remove(spark, at)
    return idx, corpus(idx, counts)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index() without the bodies, with up to 25 direct and 25 related keywords as texts, written."""
    idx, c = index_and_corpus(spark, sf_dir)
    return written(P.with_keywords(idx, c["direct"], P.related_keywords(c["direct"], c["counts"], partners=c["partners"])), "records")


def queries(idx: DataFrame) -> DataFrame:
    """Every page whose number is divisible by 100 asks with the words of its title."""
    words = S.tokens(F.col("title"))
    return idx.filter("page_id % 100 = 0").select(
        F.col("page_id").alias("query_id"), F.col("title").alias("text"), F.slice(words, 1, 1).alias("must"), F.slice(words, 2, 1).alias("must_not"),
        F.array_join(F.slice(words, 1, 2), " ").alias("phrase"), F.lit(1_704_067_200).cast("long").alias("ts_from"), F.lit(1_704_067_200 + 6000).cast("long").alias("ts_to"),
    )
