"""From captured HTML to page records: text, keywords, description.

Defined results: null html and texts count as empty and give no terms; ties between terms go by the
term; pages that share an id count together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import scalars as S
from pagetrail.operators.partners import keyword_partners, related_weights
from pagetrail.sources.scratch import written

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
HIDDEN = (r"(?is)<head(\s[^>]*)?>.*?</head>", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>")
KEYWORDS = 25


def unescaped(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(text, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with title, h1 and body (visible text) of their html; null html counts as empty."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = html
    for pattern in HIDDEN:
        body = F.regexp_replace(body, pattern, " ")
    return pages.withColumns({
        "title": _plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "h1": _plain(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)),
        "body": F.trim(F.regexp_replace(unescaped(body), r"\s+", " ")),
    })


def description(body: Column, most: int = 200) -> Column:
    """First sentence, cut at so many characters."""
    return F.substring(F.regexp_extract(body, r"^[^.!?]*[.!?]?", 0), 1, most)


def title_choice(title: Column, h1: Column, captured: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(h1, F.lit("")), captured, F.lit(""))


def term_counts(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("id"), F.explode(S.tokens(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def top_terms(weighted: DataFrame, k: int = KEYWORDS) -> DataFrame:
    """The k terms of largest weight of each id, ties by term; rank from 1."""
    best = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    return weighted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def corpus_terms(term_counts_: DataFrame, pages: DataFrame) -> DataFrame:
    """term, df, n: pages with the term and pages in all."""
    n = pages.agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row
    return term_counts_.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))


def weighted_terms(tf: DataFrame, corpus: DataFrame, k: int = KEYWORDS) -> DataFrame:
    """id, term, weight, rank by tf * ln(n / df); corpus: term, df, n of the pages themselves or of a corpus with their terms."""
    weight = F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6)
    return top_terms(tf.join(corpus.hint("merge"), "term").select("id", "term", weight.alias("weight")), k)


def direct_keywords(pages: DataFrame, id_col: str, text_col: str, k: int = KEYWORDS) -> DataFrame:
    """id, term, weight, rank: terms of the page by tf * ln(N / df)."""
    tf = term_counts(pages, id_col, text_col)
    return weighted_terms(tf, corpus_terms(tf, pages), k)


def related_keywords(direct: DataFrame, page_terms: DataFrame, k: int = KEYWORDS, partners: DataFrame | None = None) -> DataFrame:
    """id, term, weight, rank: terms that go with a page's direct keywords on other pages but are not on it.

    Weight: sum over the page's keywords of the mutual information with each of their partners.
    """
    partners = written(keyword_partners(direct), "partners") if partners is None else partners
    return top_terms(related_weights(direct, page_terms, partners, k), k)


def keyword_text(ranked: DataFrame, into: str) -> DataFrame:
    """id and the keywords of each id in rank order, joined by a space."""
    return ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("k")).select("id", S.joined_words(F.col("k.term")).alias(into))


def with_keywords(pages: DataFrame, direct: DataFrame, related: DataFrame) -> DataFrame:
    """pages(id) with the texts direct_keywords and related_keywords, empty where there are none."""
    texts = pages.join(keyword_text(direct, "direct_keywords"), "id", "left").join(keyword_text(related, "related_keywords"), "id", "left")
    return texts.withColumns({c: S.or_default(F.col(c)) for c in ("direct_keywords", "related_keywords")})


def annotate(captures: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's own model: fn takes and gives an iterator of pandas frames with that schema."""
    return captures.mapInPandas(fn, schema)


def page_records(pages: DataFrame) -> DataFrame:
    """page_index rows from extracted pages with url, title, h1, captured_title, body, direct_keywords, related_keywords, ts, user_id, stored, image, image_filename."""
    return pages.select(
        S.page_id(F.col("url")).alias("id"), "url", title_choice(F.col("title"), F.col("h1"), F.col("captured_title")).alias("title"),
        description(F.col("body")).alias("description"), S.or_default(F.col("direct_keywords")).alias("direct_keywords"), S.or_default(F.col("related_keywords")).alias("related_keywords"),
        F.col("ts").alias("timestamp"), "user_id", S.content_digest(F.col("image"), F.col("stored")).alias("image_hash"), S.or_default(F.col("image_filename")).alias("image_filename"),
    )
