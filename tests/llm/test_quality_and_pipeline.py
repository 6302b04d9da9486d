import numpy as np
import pytest

import corpus_pipeline
from pagetrail.llm import quality
from pagetrail.llm.shared import table


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, grades = table(spark, sf, "documents"), quality.graded(table(spark, sf, "labels"))
    model = quality.fit(docs, grades, sample=2500)
    assert (np.diff(model.thresholds) > 0).all()
    seen = grades.orderBy(quality.F.xxhash64("doc_id"), "doc_id").limit(2500).select("doc_id")
    rest = quality.scored(docs, model).join(grades, "doc_id").join(seen, "doc_id", "left_anti").toPandas()
    kept = rest.groupby("grade")["kept"].mean()
    assert len(rest) > 1000 and kept[2] > 0.97 and kept[0] < 0.1 and kept[1] < 0.15
    means = rest.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] < means[2]


def test_slopes_are_finite_differences():
    rng = np.random.default_rng(0)
    score, y, theta, step = rng.normal(size=50) * 2, rng.integers(0, 3, 50), np.array([-0.7, 0.9]), 1e-6
    by_score, by_theta = quality.slopes(score, y, theta)
    for k in range(50):
        move = step * (np.arange(50) == k)
        assert abs((quality.loss(score + move, y, theta) - quality.loss(score - move, y, theta)) / (2 * step) - by_score[k]) < 1e-7
    for k in range(2):
        move = step * (np.arange(2) == k)
        assert abs((quality.loss(score, y, theta + move) - quality.loss(score, y, theta - move)) / (2 * step) - by_theta[k]) < 1e-7


def test_fit_lowers_the_loss():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(400)]
    y = np.array([min(2, int((r < 10).sum())) for r in rows])
    model = quality.Ordinal().fit(rows, y)
    score = np.array([model.weights[r].sum() for r in rows])
    share = np.cumsum(np.bincount(y)[:-1]) / len(y)
    assert quality.loss(score, y, model.thresholds) < 0.75 * quality.loss(np.zeros(400), y, np.log(share / (1 - share)))


def test_op1_by_brute_force(spark, small):
    """Every document scored by a plain loop over its features with the fitted weights."""
    docs, grades = table(spark, small, "documents"), quality.graded(table(spark, small, "labels"))
    model = quality.fit(docs, grades)
    got = {r.doc_id: r for r in quality.op1_ordinal_quality(spark, small).collect()}
    for d in docs.collect():
        score = sum(float(np.float32(model.weights[k])) for k in quality.features(d.text))
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        r = got.pop(d.doc_id)
        assert abs(r.tail_probability - tails[-1]) < 2e-6 and abs(r.expected_grade - sum(tails)) < 3e-6 and r.kept == (r.tail_probability >= 0.5)
    assert not got


ODD = [(1, None, 7, "a"), (None, "x y z", 1, "b"), (2, "", 1, None), (2, "", 1, None), (3, "word " * 40_000, 1, "c"), (4, "some words of a text", 2, "d"), (4, "some words of a text", 2, "d")]


@pytest.mark.parametrize("rows,labels", [(ODD, [(4, 1, 0), (1, 0, 1), (None, 1, 0)]), (ODD, []), ([], [])])
def test_pipeline_odd_rows(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, label_id int, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(0 < r.length <= 2048 for r in out)
    if rows and not labels:  # nothing is rejected; a text's copies leave one row, or several with equal ids
        assert {r.doc_id for r in out} == {2, None, 3, 4}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "x" * 100_000, 1.0), (3, "a b", 1.0), (3, "a b", 1.0)], "doc_id long, text string, expected_grade double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (2, None, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    grades = quality.graded(labels)
    assert sorted(map(tuple, grades.collect())) == [(1, 0), (3, 1)]
    model = quality.fit(docs, grades)
    out = quality.scored(docs, model)
    assert out.count() == 5 and out.columns == ["doc_id", "expected_grade", "tail_probability", "kept"]
    assert quality.select_quality(docs, model).columns == docs.columns
    none = quality.fit(docs, grades.limit(0))
    assert none is None and quality.select_quality(docs, none).count() == 5 and quality.scored(docs, none).filter("kept").count() == 5
    assert quality.scored(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def stages(spark, middle):
    docs, out = table(spark, middle, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, middle).cache()
        out.append(docs)
    return out


def test_pipeline_keeps_columns_and_clean_documents(spark, middle, stages):
    docs, fine, exact, near, cut, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    labels = quality.graded(table(spark, middle, "labels"))
    kept = {r.doc_id for r in fine.collect()}
    by_grade = {g: [r.doc_id in kept for r in labels.collect() if r.grade == g] for g in (0, 2)}
    assert np.mean(by_grade[2]) > 0.98 and np.mean(by_grade[0]) < 0.05
    assert exact.count() == fine.select("text").distinct().count()
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in cut.collect()} <= {r.doc_id for r in exact.collect()}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}


def test_pipeline_near_stage_by_brute_force(stages):
    from tests.llm.test_dedup import linked_by_brute_force

    exact, near = stages[2].orderBy("doc_id").collect(), stages[3].collect()
    want, _ = linked_by_brute_force([d.doc_id for d in exact], [d.text for d in exact], 5, 80)
    assert {r.doc_id for r in near} == {i for i, c in want.items() if i == c}


def test_pipeline_leaves_no_repeated_passage(stages):
    """What is cut is what brute force finds in the stage's input, but for characters covered in part."""
    from collections import Counter

    n = corpus_pipeline.PASSAGE
    raws = {r.doc_id: r.text.encode() for r in stages[3].collect()}
    seen = Counter(raw[i : i + n] for raw in raws.values() for i in range(len(raw) - n + 1))
    for r in stages[4].collect():
        raw = raws[r.doc_id]
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - n + 1):
            if seen[raw[i : i + n]] > 1:
                gone[i : i + n] = True
        kept, left = int((~gone).sum()), len(r.text.encode())
        assert kept <= left <= kept + 6 * (1 + int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())) and r.n_chars == len(r.text)
