"""Hits from bounded blocks are those of scoring every posting, and most postings are not read for them."""

import random

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import blocks, search
from pagetrail.sources import tables

FIELDS = ("title", "description")
WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Pages of a term that all have, of frequent and rare ones; a rare one gathers in the newest pages."""
    pick = random.Random(5)
    rows = []
    for k in range(600):
        body = ["all", *pick.choices(WORDS, [1 / (j + 1) for j in range(60)], k=pick.randint(3, 40)), *(["late"] * (k > 590))]
        rows.append((None if k == 7 else k, f"u{k}", " ".join(pick.sample(body, 3)), " ".join(body), None if k % 97 == 5 else (k // 3) * 10, k % 2))
    rows.append((700, "empty", "", None, 5, 0))
    pages = spark.createDataFrame(rows, "id long, url string, title string, description string, timestamp long, user_id long")
    postings = search.build_postings(pages, FIELDS)
    path = f"file://{tmp_path_factory.mktemp('index')}/index"
    tables.write_index(postings, path, pages=pages, size=16)
    return pages, *tables.open_index(spark, path)


FORMS = [
    {},
    {"fields": ("title",)},
    {"page": 1},
    {"size": 700},
    {"user_id": 1},
    {"more": "ts_from long, ts_to long", "values": [(500, 900), (None, 300), (1500, None), (None, None), (5, 4), (0, 10)]},
    {"more": "must array<string>", "values": [(["w3"],), ([],), (None,), (["w1", "w2"],), (["none"],), (["late"],)]},
    {"more": "must_not array<string>", "values": [(["w0"],), (["late"],), ([],), (["all"],), (None,), (["w5"],)]},
    {"more": "phrase string", "values": [("all w0",), ("",), (None,), ("w0 w0",), ("late late",), ("w1",)]},
]


@pytest.mark.parametrize("form", FORMS, ids=lambda f: f.get("more", str(f)))
def test_same_hits_as_full_scoring(spark, stored, form):
    pages, postings, stats = stored
    form = dict(form)
    more, values = form.pop("more", None), form.pop("values", [()] * 6)
    texts = ["all", "w0 all", "late w0 all", "w40 w41 w0", "none", None]
    asked = spark.createDataFrame([(q, t, *v) for (q, t), v in zip(enumerate(texts), values, strict=True)], "query_id long, text string" + (f", {more}" if more else ""))
    got = search.search(pages, postings, asked, stats=stats, **form)
    want = search.search(pages, postings, asked, stats={k: v for k, v in stats.items() if k != "blocks"}, **form)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_blocks_are_bounded_and_whole(spark, stored):
    _, postings, stats = stored
    sizes = stats["blocks"].select(F.size("entries").alias("n"), "lo", "hi", "range")
    assert sizes.agg(F.max("n")).first()[0] <= 16
    assert sizes.agg(F.sum("n")).first()[0] == postings.count()
    assert stats["blocks"].filter("term = 'all'").count() >= 600 // 16  # a term on every page is in many blocks


def test_most_postings_are_not_read(spark, stored):
    _, _, stats = stored
    asked = spark.createDataFrame([(1, "late all w0")], "query_id long, text string")
    met = blocks.asked_blocks(stats["blocks"], stats, search.query_terms(asked), asked)
    picked = blocks.ordered(blocks.ranges_of(met)).filter("__place <= 4")
    scores = blocks.scored(stats["blocks"], met.join(picked, ["query_id", "range"], "left_semi"))
    rest = blocks.survivors(met, scores, 5, 4, True)
    everything = met.select("range").distinct().count()
    assert everything > 30 and rest.count() <= everything // 4


def test_terms_and_times_reach_the_scan(spark, stored):
    _, _, stats = stored
    asked = spark.createDataFrame([(1, "late", 1900, 2000), (2, "w3", 1950, 3000)], "query_id long, text string, ts_from long, ts_to long")
    met = blocks.asked_blocks(stats["blocks"], stats, search.query_terms(asked), asked)
    plan = spark._jvm.PythonSQLUtils.explainString(met._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(hi,1900)" in plan and "LessThanOrEqual(lo,3000)" in plan and "In(term" in plan
    assert all("entries" not in line for line in plan.split("\n") if line.startswith("ReadSchema"))
    assert met.agg(F.min("range")).first()[0] > stats["blocks"].agg(F.min("range")).first()[0]


def test_ranges_of_equal_bounds_are_scored_once(spark, tmp_path, monkeypatch):
    """Rows of bounds come in another order each time they are read, as from a shuffle, and their sums differ by the last bit."""
    pages = spark.createDataFrame([(k, f"u{k}", "a b c d e f", "a b b c c c d e f g h", k) for k in range(160)], "id long, url string, title string, description string, timestamp long")
    more = spark.createDataFrame([(1000 + k, f"v{k}", "b c d e f"[: 2 * (k % 5) + 1], "x", 10_000) for k in range(40)], pages.schema)
    pages = pages.unionByName(more)
    tables.write_index(search.build_postings(pages, FIELDS), f"file://{tmp_path}/index", pages=pages, size=4)
    postings, stats = tables.open_index(spark, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(q, text) for q, text in enumerate(["a b c d e f", "f e d c", "a c e g", "b d f h"] * 8)], "query_id long, text string")
    sums, seeds = blocks.ranges_of, iter(range(99))
    monkeypatch.setattr(blocks, "ranges_of", lambda met: sums(met.coalesce(1).sortWithinPartitions(F.rand(next(seeds)))))
    got = search.search(pages, postings, asked, stats=stats, size=30)
    want = search.search(pages, postings, asked, stats={k: v for k, v in stats.items() if k != "blocks"}, size=30)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_many_bounds_are_merged(spark, stored, monkeypatch):
    """Bounds beyond SENT rows are no broadcast, however small Spark takes their file to be; the hits are the same."""
    _, _, stats = stored
    asked = spark.createDataFrame([(1, "late all w0")], "query_id long, text string")

    def found():
        best = blocks.best(stats, search.query_terms(asked), asked, 5)
        return spark._jvm.PythonSQLUtils.explainString(best._jdf.queryExecution(), "simple"), sorted(map(tuple, best.collect()))

    few, want = found()
    monkeypatch.setattr(blocks, "SENT", 0, raising=False)
    many, got = found()
    assert "SortMergeJoin [field#" in many and "SortMergeJoin [field#" not in few
    assert {r[:2] for r in want} == {r[:2] for r in got} and want


def test_empty_index(spark, stored, tmp_path):
    pages = stored[0].filter("false")
    tables.write_index(search.build_postings(pages, FIELDS), f"file://{tmp_path}/none", pages=pages)
    postings, stats = tables.open_index(spark, f"file://{tmp_path}/none")
    asked = spark.createDataFrame([(1, "all")], "query_id long, text string")
    assert search.search(pages, postings, asked, stats=stats).collect() == []
