"""Postings, corpus statistics and batches of ranked queries (BM25, a score per field, summed).

Statistics come with a stored index (`sources.tables.open_index`) or are computed from the postings.
Defined results: null texts have no terms; a query without terms, or whose terms occur nowhere, has no
hits; ties go by id; a null `must`, `must_not`, `phrase`, `ts_from` or `ts_to` asks for nothing; pages that
share an id count as one, shown as the newest of them; a null id is an id; an empty index gives no hits.
An index that is stored with blocks (`operators.blocks`) gives the same hits and reads fewer postings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import scalars as S
from pagetrail.operators import blocks
from pagetrail.operators.blocks import K1, B


def build_postings(index: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """field, term, id, tf, positions (ascending, from 0) of the text fields of page records; keep: columns that go with the id."""
    parts = [index.select(F.lit(f).alias("field"), "id", *keep, F.posexplode(S.tokens(F.col(f))).alias("pos", "term")) for f in fields]
    return reduce(DataFrame.unionByName, parts).groupBy("field", "term", "id", *keep).agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def doc_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "id").agg(F.sum("tf").alias("dl"))


def field_stats(docs: DataFrame) -> DataFrame:
    """field, n, total, avgdl: pages with words in a field, and their words."""
    return docs.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), F.avg("dl").alias("avgdl"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("term"))


def scored(postings: DataFrame, queries: DataFrame, fields: tuple[str, ...] | None = None, stats: dict[str, DataFrame] | None = None) -> DataFrame:
    """query_id, id, score of every page with any term of the query's text, rounded to 6 places.

    Only postings of queried terms are joined with their lengths; statistics are those of all postings.
    stats: stored tables docs (doc_stats), fields (field_stats) and terms (term_stats).
    """
    terms = query_terms(queries)
    docs = stats["docs"] if stats else doc_stats(postings)
    fields_ = stats["fields"] if stats else field_stats(docs)
    hit = postings.filter(F.col("field").isin(list(fields))) if fields else postings
    asked = hit.join(terms, "term").select("query_id", "field", "term", "id", "tf")
    df = stats["terms"] if stats else term_stats(hit.join(terms.select("term").distinct(), "term", "left_semi"))
    lengths = docs.select(F.col("field").alias("__field"), F.col("id").alias("__id"), "dl")
    rows = asked.join(df, ["field", "term"]).join(lengths, (F.col("field") == F.col("__field")) & F.col("id").eqNullSafe(F.col("__id")))
    rows = rows.join(F.broadcast(fields_), "field")  # a row per field
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.withColumn("w", weight).groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))


def having_terms(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, id) of pages that hold all terms of wanted(query_id, term), in whichever field."""
    terms = wanted.distinct()
    need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    have = postings.select("term", "id").join(terms, "term").distinct().groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("have"))
    return have.join(need, "query_id").filter("have = need").select("query_id", "id")


def having_any(postings: DataFrame, unwanted: DataFrame) -> DataFrame:
    return postings.join(unwanted.distinct(), "term").select("query_id", "id").distinct()


def having_phrase(postings: DataFrame, queries: DataFrame, stats: dict[str, DataFrame] | None = None) -> DataFrame:
    """(query_id, id) of pages with the tokens of `phrase` one after the other in one field.

    Pages come from the word of the phrase with the fewest pages in a field; of the other words only the
    postings of those pages are read on, and the ascending positions of a page are intersected, shortest
    list first. No position becomes a row.
    """
    words = queries.select("query_id", F.posexplode(S.tokens(F.col("phrase"))).alias("at", "term"))
    size = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    df = stats["terms"] if stats else term_stats(postings.join(words.select("term").distinct(), "term", "left_semi"))
    known = words.join(df, "term").join(size, "query_id")
    rarest = known.groupBy("query_id", "field").agg(F.min_by("term", F.struct("df", "at")).alias("term"), F.countDistinct("at").alias("have"), F.first("size").alias("size"))
    rarest = rarest.filter("have = size").select("query_id", "field", "term")  # a field without one of the words has no hit
    pages = postings.select("field", "term", "id").join(rarest, ["field", "term"]).select("query_id", "field", F.col("id").alias("__id"))
    asked = known.join(rarest.select("query_id", "field"), ["query_id", "field"]).select("query_id", "field", "term", "at", "size")
    met = postings.join(asked, ["field", "term"]).alias("p")
    here = pages.withColumnsRenamed({"query_id": "__query", "field": "__field"})
    met = met.join(here, (F.col("query_id") == F.col("__query")) & (F.col("field") == F.col("__field")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    lists = met.groupBy("query_id", "field", "id", "size").agg(F.sort_array(F.collect_list(F.struct(F.size("positions").alias("n"), "at", "positions"))).alias("lists"))
    first = F.transform(F.col("lists")[0]["positions"], lambda p: p - F.col("lists")[0]["at"])
    starts = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), first, lambda left, x: F.filter(left, lambda p: F.array_contains(x["positions"], p + x["at"])))
    return lists.filter(F.size("lists") == F.col("size")).filter(F.size(starts) > 0).select("query_id", "id").distinct()


def paged(scores: DataFrame, page: int = 0, size: int = 10) -> DataFrame:
    """rank and rows of one page for every query; ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= (page + 1) * size) & (F.col("rank") > page * size))


def hits(ranked: DataFrame, index: DataFrame) -> DataFrame:
    shown = ranked.join(index.select(F.col("id").alias("__id"), "title", "description", "timestamp", "url"), F.col("id").eqNullSafe(F.col("__id")))
    newest = Window.partitionBy("query_id", "rank").orderBy(F.desc("timestamp"), "url")
    shown = shown.withColumn("__one", F.row_number().over(newest)).filter("__one = 1")
    return shown.select("query_id", "rank", "score", "title", "description", "timestamp", "url")


def of_pages(found: DataFrame, pages: DataFrame, how: str) -> DataFrame:
    """found, semi or anti joined with pages(query_id, id); a null id is an id."""
    named = pages.select(F.col("query_id").alias("__query"), F.col("id").alias("__id"))
    return found.join(named, (F.col("query_id") == F.col("__query")) & F.col("id").eqNullSafe(F.col("__id")), how)


def restricted(found: DataFrame, index: DataFrame, postings: DataFrame, queries: DataFrame, user_id: int | None = None, stats: dict[str, DataFrame] | None = None) -> DataFrame:
    """Scored pages that have what the queries ask for beside their text."""
    have = set(queries.columns)
    if "must" in have:
        asked = queries.filter(F.size("must") > 0)
        all_of = having_terms(postings, asked.select("query_id", F.explode("must").alias("term")))
        free = queries.filter(F.coalesce(F.size("must"), F.lit(0)) <= 0).select("query_id")
        found = of_pages(found, all_of, "left_semi").unionByName(found.join(free, "query_id", "left_semi"))
    if "must_not" in have:
        found = of_pages(found, having_any(postings, queries.select("query_id", F.explode("must_not").alias("term"))), "left_anti")
    if "phrase" in have:
        free = queries.filter(F.coalesce(F.col("phrase"), F.lit("")) == "").select("query_id")
        found = of_pages(found, having_phrase(postings, queries, stats), "left_semi").unionByName(found.join(free, "query_id", "left_semi"))
    if "ts_from" in have:
        asked = queries.select("query_id", "ts_from", "ts_to")
        span = found.join(asked, "query_id").join(index.select(F.col("id").alias("__id"), "timestamp"), F.col("id").eqNullSafe(F.col("__id")))
        late = F.col("ts_from").isNull() | (F.col("timestamp") >= F.col("ts_from"))
        early = F.col("ts_to").isNull() | (F.col("timestamp") <= F.col("ts_to"))
        found = span.filter(late & early).select("query_id", "id", "score").distinct()
    if user_id is not None:
        own = index.filter(F.col("user_id") == user_id).select(F.col("id").alias("__id"))
        found = found.join(own, F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    return found


def search(index: DataFrame, postings: DataFrame, queries: DataFrame, fields: tuple[str, ...] | None = None, page: int = 0, size: int = 10, user_id: int | None = None, stats: dict[str, DataFrame] | None = None) -> DataFrame:
    """A page of hits for each row of queries.

    queries: query_id, text, and where wanted must, must_not (arrays of terms), phrase, ts_from, ts_to.
    stats: those of a stored index; with its blocks only postings that can reach the page are scored.
    """

    def keep(found: DataFrame) -> DataFrame:
        return restricted(found, index, postings, queries, user_id, stats)

    if stats and "blocks" in stats:
        free = user_id is None and not {"must", "must_not", "phrase", "ts_from"} & set(queries.columns)
        found = blocks.best(stats, query_terms(queries), queries, (page + 1) * size, fields, None if free else keep)
    else:
        found = keep(scored(postings, queries, fields, stats))
    return hits(paged(found, page, size), index)


def update_postings(postings: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """postings without those of changed(id), with the new ones; statistics are derived from the result."""
    gone = changed.select(F.col("id").alias("__id")).distinct()
    return postings.join(gone, F.col("id").eqNullSafe(F.col("__id")), "left_anti").unionByName(new).select(*postings.columns)
