"""URL filters: rules on host and path, then a list of URLs behind a blocked Bloom filter.

The listed canonical URLs become a filter of 256-bit blocks, eight bits a URL inside the one block
that its hash names. The filter is a table of at most `MAX_BLOCKS` rows (about 5 MB), so it can be
broadcast whatever the length of the list; a longer list only lets more pass. Pages whose bits are
all set go on to an exact hash join with the list, which removes the false positives. Other pages
are never shuffled.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and is in no
list; ties between rules of one length cannot arise, as both would be the same suffix and prefix;
repeated rows are judged alike; an empty list blocks nothing; other
columns are carried along, and one named `url_verdict` is replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm.bloom import MAX_BLOCKS, probed
from pagetrail.llm.shared import table, written

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)"
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, path without closing slashes, query without tracking and in order; null where there is no host."""
    query = F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    rest = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), rest))


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], result) -> Column:
    """result(rule) of the longest rule that fits, else null."""
    found = F
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        found = found.when(fits, F.lit(result(rule)))
    return found if rules else F.lit(None).cast("string")


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", listed_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """pages with host, path, rule, maybe (passed the filter) and verdict in a struct `url_verdict`.

    listed: URLs that are blocked where no rule decides.
    """
    keys = written(listed.select(canonical(F.col(listed_col)).alias("key")).filter("key IS NOT NULL").distinct(), "listed")
    url = pages[url_col].cast("string")
    judged = pages.select(F.struct(*[pages[c] for c in pages.columns if c != "url_verdict"]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    judged = judged.withColumns({
        "rule": by_rule(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]),
        "verdict": by_rule(F.col("host"), F.col("path"), rules, lambda r: r[0]),
    })
    asked = judged.withColumn("asked", F.when(F.col("rule").isNull(), F.col("key")))
    seen = probed(asked, "asked", keys, "key", max_blocks=max_blocks)

    shown = [F.col("row"), F.col("host"), F.col("path"), F.col("rule"), F.col("maybe")]
    clear = seen.filter(~F.col("maybe")).select(*shown, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    exact = keys.withColumn("listed", F.lit(True))
    asked = seen.filter("maybe").join(exact.hint("shuffle_hash"), "key", "left").select(*shown, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
    return clear.unionByName(asked).select("row.*", F.struct("host", "path", "rule", "maybe", "verdict").alias("url_verdict"))


def known_bad_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the pages whose document is labelled toxic or of low quality: the list of op4."""
    number = F.regexp_extract("url", r"/[a-z]{2}/([0-9]+)", 1)
    pages = table(spark, sf_dir, "pages").select("url", F.when(number != "", number.try_cast("long")).alias("doc_id"))
    bad = table(spark, sf_dir, "labels").filter("toxic = 1 OR quality = 0").select("doc_id").distinct()
    return pages.join(bad, "doc_id", "left_semi").select("url")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter(pages, known_bad_urls(spark, sf_dir))
    return out.select("page_id", "url_verdict.host", "url_verdict.path", "url_verdict.rule", "url_verdict.verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), ''), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) AS query
  FROM pages),
c AS (
  SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN regexp_replace(host, '^www\.', '')
      || regexp_replace(path, '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS key
  FROM p),
listed AS (
  SELECT DISTINCT key FROM c WHERE key IS NOT NULL AND try_cast(nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') AS BIGINT)
    IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)),
r AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": SQL}
