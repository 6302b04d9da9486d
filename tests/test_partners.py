"""Related keywords by blocks and parts are those of the plain product."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from pagetrail.operators import pages, partners
from pagetrail.sources.scratch import own_dir, written


def plain(direct, held, k):
    words = defaultdict(set)
    for i, t in direct:
        if t is not None:
            words[i].add(t)
    on = Counter(t for w in words.values() for t in w)
    both = Counter((a, b) for w in words.values() for a in w for b in w if a != b)
    pmi = {(a, b): round(math.log(c * len(words) / (on[a] * on[b])), 6) for (a, b), c in both.items() if c >= 2}
    of = defaultdict(list)
    for (a, b), w in pmi.items():
        of[a].append((b, w))
    out = []
    for i, w in words.items():
        total = defaultdict(float)
        for a in w:
            for b, x in of[a]:
                total[b] += x
        best = sorted(((-round(x, 6), b) for b, x in total.items() if (i, b) not in held))[:k]
        out += [(i, b, -x, r) for r, (x, b) in enumerate(best, 1)]
    return pmi, sorted(out, key=repr)


@pytest.fixture(scope="module")
def made():
    """One keyword is on all pages, others are frequent or rare; nulls and repeated rows among them."""
    pick = random.Random(8)
    names = [f"t{j}" for j in range(90)] + ["é", "日本", "Z"]
    direct = []
    for i in [None, *range(300)]:
        direct += [(i, t) for t in {"all", *pick.choices(names, [1 / (j + 1) for j in range(93)], k=8)}]
    held = {(i, t) for i, t in direct} | {(i, pick.choice(names)) for i in [None, *range(300)]} | {(i, "elsewhere") for i in range(50)}
    return direct + direct[:9] + [(4, None), (999, None)], sorted(held, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, term string")


@pytest.mark.parametrize("size, parts", [(16, 3), (7, 1), (2048, 8)])
def test_same_as_the_plain_product(spark, made, size, parts):
    direct, held = made
    pmi, want = plain(direct, set(held), 5)
    d, h = frame(spark, direct), frame(spark, held)
    pairs = partners.keyword_partners(d)
    assert {(r.a, r.b): r.pmi for r in pairs.collect()} == pytest.approx(pmi)
    got = pages.top_terms(partners.related_weights(d, h, pairs, 5, size, parts), 5)
    assert sorted(((r.id, r.term, round(r.weight, 6), r["rank"]) for r in got.collect()), key=repr) == want and want


def test_batches_cut_anywhere(made, monkeypatch):
    import pyarrow as pa

    pick = random.Random(2)
    rows = [(0, part, -1, a, page, 0) for part in (0, 1) for page in range(40) for a in pick.sample(range(30), 6)]
    rows += [(0, b % 2, b, a, -1, pick.randint(-3, 9)) for b in range(200) for a in pick.sample(range(30), pick.randint(1, 20))]
    rows += [(0, b % 2, b, -1, page, 0) for b in range(200) for page in pick.sample(range(45), 5)]
    rows.sort(key=lambda r: r[:3])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def best(step):
        cut = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + step]), kinds)], ["block", "part", "b", "a", "page", "micros"]) for k in range(0, len(rows), step))
        return sorted(tuple(r.values()) for batch in partners.best_of_blocks(4)(cut) for r in batch.to_pylist())

    want = best(len(rows))
    monkeypatch.setattr(partners, "SUMMED", 50)
    monkeypatch.setattr(partners, "CANDIDATES", 3)
    monkeypatch.setattr(partners, "WAITING", 20)
    assert best(7) == best(1) == best(1000) == want and len(want) > 100


def test_a_keyword_of_all_pages_is_many_groups(spark, made):
    direct, held = made
    d, h = frame(spark, direct), frame(spark, held)
    pairs = partners.keyword_partners(d)
    plan = partners.related_weights(d, h, pairs, 5, 16, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [block" in plan and "Window" not in plan


def test_empty(spark):
    none, one = frame(spark, []), frame(spark, [(1, "a")])
    assert partners.keyword_partners(none).count() == 0
    assert pages.related_keywords(none, none).count() == pages.related_keywords(one, one).count() == pages.related_keywords(one, none).count() == 0


def joins(df):
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return [line.strip(" :+-") for line in plan.split("\n") if re.search(r"(HashJoin|SortMergeJoin) ", line)]


def test_no_broadcast_of_what_grows(spark, made, monkeypatch):
    """Guessed sizes of such small tables would all allow it: only the 200 frequent words and rows of a page are sent."""
    direct, held = (frame(spark, rows) for rows in made)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20
    pairs = partners.keyword_partners(direct)
    assert all(j.startswith("SortMergeJoin") for j in joins(pairs)) and len(joins(pairs)) == 2
    met, write = [], partners.written
    monkeypatch.setattr(partners, "written", lambda df, *how: met.extend(joins(df)) or write(df, *how))
    met += joins(partners.related_weights(direct, held, write(pairs, "pairs"), 5))
    assert sum(bool(re.match(r"SortMergeJoin \[(a|b|term|key)#", j)) for j in met) >= 4, met
    assert any(re.match(r"SortMergeJoin \[a#\w+, part#\w+\]", j) for j in met), met
    counts = pages.corpus_terms(direct.groupBy("id", "term").count(), direct)
    assert [j[:13] for j in joins(pages.weighted_terms(held.selectExpr("id", "term", "1 AS tf"), counts))] == ["SortMergeJoin"]


def test_passes_leave_candidates_alone(spark, made):
    """The same rows where parts are taken in passes; of what the passes read nothing stays, nor do shuffle files."""
    direct, held = made
    pmi, want = plain(direct, set(held), 5)
    pairs = written(partners.keyword_partners(frame(spark, direct)), "pairs")
    before = {p.name for p in Path(own_dir(spark).removeprefix("file://")).iterdir()}
    old = set(shuffles(spark))
    got = partners.related_weights(frame(spark, direct), frame(spark, held), pairs, 5, 16, 7, most=1)
    left = sorted(p.name.split("-")[0] for p in Path(own_dir(spark).removeprefix("file://")).iterdir() if p.name not in before)
    assert left == ["candidates"] * 4 + ["pages", "vocabulary"]
    assert set(shuffles(spark)) <= old
    assert sorted(((r.id, r.term, round(r.weight, 6), r["rank"]) for r in pages.top_terms(got, 5).collect()), key=repr) == want and want


def shuffles(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return [f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and Path(f).exists()]
