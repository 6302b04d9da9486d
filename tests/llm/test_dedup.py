import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.llm import components, minhash, suffix_dedup, vector_dedup
from pagetrail.llm.hashing import prefix_sums, range_hashes
from pagetrail.llm.shared import table


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == joined(pairs, nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(texts, k):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(upper))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def linked_by_brute_force(ids, texts, k, percent):
    sets, pairs = sets_of(texts, k), []
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((ids[i], ids[j]))
    return joined(pairs, ids), [len(s) for s in sets]


@pytest.mark.parametrize("chunk", [4, 1500])
def test_near_links(spark, chunk):
    rng, rows = random.Random(5), []
    for g in range(6):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.choice([2, 3, 60, 300]))]
        for c in range(12):
            words = list(base)
            for _ in range(c * len(words) // 150):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(words) if c % 2 else "\t".join(words).upper()))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "É"), (506, "é"), (507, rows[40][1]), (508, "w " * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component int")
    got = {r.doc_id: r for r in minhash.near_links(docs, 3, 85, chunk=chunk).collect()}
    want, sizes = linked_by_brute_force([r[0] for r in rows], [r[1] for r in rows], 3, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[r[0]].n_shingles for r in rows] == sizes and all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    stays = minhash.near_dedup(docs, 3, 85)
    assert stays.columns == docs.columns and {r.doc_id for r in stays.collect()} == {i for i, c in want.items() if i == c}


def test_near_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_links(docs, 3, 85).collect()), key=repr)
    assert got == [(3, 2, 3), (3, 2, 3), (None, 0, None), (None, 2, None)]
    assert minhash.near_links(docs.limit(0), 3, 85).count() == 0


def test_near_links_of_each_text_of_an_id(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.random()}" for _ in range(100)) for _ in range(3)]
    rows = [(1, t) for t in texts] + [(k, t + " end") for k, t in enumerate(texts, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_links(docs, 3, 85).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_op6(spark, small):
    docs = table(spark, small, "documents").orderBy("doc_id").collect()
    want, _ = linked_by_brute_force([d.doc_id for d in docs], [d.text for d in docs], 3, 85)
    assert {r.doc_id: r.component_id for r in minhash.op6_minhash_bayes(spark, small).collect()} == want


def test_posterior_bounds_keep_true_pairs():
    for n, least in minhash.least_matches(120, 0.85):
        assert np.random.default_rng(n).binomial(n, 0.85, 200_000).min() >= least - 1


@pytest.mark.parametrize("hashes,t", [(120, 0.85), (180, 0.80)])
def test_pruning_misses_no_more_than_stated(hashes, t):
    from math import comb

    dropped = sum(comb(n, m) * t**m * (1 - t) ** (n - m) for n, least in minhash.least_matches(hashes, t) for m in range(least))
    assert dropped <= minhash.MISS


def removed_by_brute_force(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(10, 60)) for _ in range(6)]
    out = [None, "", "short", "ab" * 300, "ab" * 200, "x" * 500, "Atre " * 300, "Atre " * 120 + "end"]
    for _ in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            parts += [p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)], text(rng.randint(0, 20))]
        out.append(" ".join(parts))
    return out + out[-3:]


@pytest.mark.parametrize("length,hot", [(100, 20_000), (100, 1), (60, 20_000), (150, 3)])
def test_passages(spark, length, hot):
    texts = passages(length + hot)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removals(docs, length, hot=hot).collect()}
    assert got == dict(enumerate(removed_by_brute_force(texts, length)))


@pytest.mark.parametrize("parts", [1, 2])
@pytest.mark.parametrize("hot", [20_000, 1])
def test_texts_whose_rolling_hashes_collide_stay(spark, parts, hot):
    rng = random.Random(8)
    turn = np.array([bin(i).count("1") % 2 for i in range(1024)])  # any polynomial hash modulo 2^64 collides on the two
    one, other = (bytes(np.where(turn == k, ord("a"), ord("b")).astype(np.uint8)) for k in (0, 1))
    sums = [prefix_sums(np.frombuffer(x, np.uint8)) for x in (one, other)]
    whole = np.array([0]), np.array([1024])
    assert one != other and range_hashes(sums[0], *whole) == range_hashes(sums[1], *whole)
    rows = []
    for _ in range(30):
        before, after = ("".join(rng.choice("cdefghij ") for _ in range(60)) for _ in range(2))
        rows += [(len(rows) + k, before + x.decode() + after) for k, x in enumerate((one, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert all(r.n_removed == 0 for r in suffix_dedup.removals(docs, 1100, hot=hot).collect())
    twice = docs.unionByName(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(99).cast("long")))
    assert {r.doc_id for r in suffix_dedup.removals(twice, 1100, hot=hot).filter("n_removed > 0").collect()} == {4, 99}


def test_meeting_is_the_same_in_any_batches():
    rng = np.random.default_rng(2)
    n = 4000
    first, whole = rng.integers(0, 60, n), rng.integers(0, 3, n) * rng.integers(0, 40, n)
    order = np.lexsort((whole % 7, whole // 7, first))
    doc_id, times = np.arange(n), np.where(rng.random(n) < 0.1, 2, 1)
    rows = suffix_dedup._rows(1, first[order], whole[order] // 7, whole[order] % 7, doc_id[order], doc_id[order], np.full(n, 500), np.full(n, 10), np.full(n, 400), times[order])

    def met(size):
        out = suffix_dedup.meet((rows.slice(k, size) for k in range(0, n, size)))
        return sorted(tuple(r.values()) for b in out for r in b.to_pylist())

    whole_ = met(n)
    total = Counter()
    for f, w, t in zip(first, whole, times):
        total[f, w] += int(t)
    assert [r[4] for r in whole_ if r[0] == 0] == sorted(int(i) for i in doc_id if total[first[i], whole[i]] > 1 and times[i] == 1)
    for size in (1, 3, 50, 1000):
        got = met(size)
        assert [r for r in got if r[0] == 0] == [r for r in whole_ if r[0] == 0]
        assert {r[1:4] for r in got if r[0] == 2} >= {r[1:4] for r in whole_ if r[0] == 2}


def test_passages_odd_rows(spark):
    text = " ".join(map(str, range(200)))
    docs = spark.createDataFrame([(None, text, 1), (1, text + "!", 2), (1, None, 3), (2, "é" * 300, 4), (3, "xé" + "é" * 299, 5), (4, "own " + "words", 6)], "doc_id long, text string, start int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.removals(docs, 100).collect()), key=repr)
    assert got == sorted([(None, len(text), len(text)), (1, len(text) + 1, len(text)), (1, 0, 0), (2, 600, 600), (3, 601, 600), (4, 9, 0)], key=repr)
    cut = suffix_dedup.suffix_dedup(docs, 100)
    assert cut.columns == docs.columns
    assert {r.start: r.text for r in cut.collect()} == {1: "", 2: "!", 3: None, 4: "", 5: "x", 6: "own words"}
    assert suffix_dedup.removals(docs.limit(0), 100).count() == 0 and suffix_dedup.suffix_dedup(docs.limit(0), 100).count() == 0


def test_op3(spark, small):
    docs = table(spark, small, "documents").orderBy("doc_id").collect()
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op3_prefix_free_parsing(spark, small).orderBy("doc_id").collect()]
    assert got == removed_by_brute_force([d.text for d in docs], 400)


def test_what_is_left_of_planted_passages(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(6, 9))) for _ in range(n))
    planted = [words(60) for _ in range(5)]
    rows, left = [(0, None), (1, "")], {0: "", 1: ""}
    for i in range(2, 42):
        a, b, p = words(30), words(30), planted[i % 5]
        rows.append((i, f"{a}\n{p}\n{b}" if i % 2 else f"{a}\n{b}"))
        left[i] = f"{a}\n\n{b}" if i % 2 else f"{a}\n{b}"
    rows += [(50, "é" * 300), (51, "xé" + "é" * 298 + "y"), (52, "ñ" + words(1)), (53, "\u00a9" + "z" * 399 + "c"), (54, "\u00e9" + "z" * 399 + "d")]
    left |= {50: "", 51: "xy", 52: rows[-3][1], 53: "\ufffdc", 54: "\ufffdd"}  # the last two share the second byte of a character
    got = {r.doc_id: r for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for (i, text), want in zip(rows, removed_by_brute_force([t for _, t in rows], 400), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        assert not any(p[10:-10] in r.text for p in planted)
        if i < 2 or want[1] == 0 or i >= 50:
            assert r.text == left[i]
        elif i % 2:  # windows may reach a line break or a byte further than the passage
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and abs(len(r.text) - len(left[i])) <= 6
    assert {i for i, r in got.items() if r.n_removed} == {i for i in range(2, 42) if i % 2} | {50, 51, 53, 54}


def vectors_by_brute_force(rows):
    pairs, n = [], Counter()
    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[:i]:
            sound = all(v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v) for v in (x, y))
            if sound and p is not None and p == q and a is not None and b is not None and len(x) == len(y):
                x_, y_ = np.array(x, float), np.array(y, float)
                if x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= 0.98:
                    pairs.append((a, b))
                    n[a] += 1
                    n[b] += 1
    return {i: (n[i], c) for i, c in joined(pairs, [r[0] for r in rows]).items()}


@pytest.mark.parametrize("first_grid,chunk", [(20_000, 4000), (20, 4000), (20, 7)])
def test_vectors(spark, monkeypatch, first_grid, chunk):
    monkeypatch.setattr(vector_dedup, "FIRST_GRID", first_grid)
    rng, rows = np.random.default_rng(1), []
    for g in range(12):
        base = rng.normal(size=16)
        for k in range(15):
            v = base + rng.normal(size=16) * rng.choice([0, 0.05, 0.1, 0.2, 0.3])
            rows.append((len(rows) * 3 % 1009, (v * rng.choice([1, 1, 5])).astype(np.float32).tolist(), int(g % 3)))
    one = rows[0][1]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan"), *one[1:]], 0), (2003, [None, *one[1:]], 0), (2004, one, None), (2005, one[:4], 0), (2006, [], 0), (2007, one, 0), (2008, [float("inf"), *one[1:]], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.vector_links(df, chunk=chunk).collect()}
    assert got == vectors_by_brute_force(rows)
    assert vector_dedup.vector_links(df.limit(0)).count() == 0


def test_double_vectors_at_the_threshold(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(150):
        a = rng.normal(size=24)
        a /= np.sqrt(a @ a)
        b = rng.normal(size=24)
        b -= (a @ b) * a
        b /= np.sqrt(b @ b)
        c = 0.98 + rng.choice([-1, 1]) * 10.0 ** -rng.integers(8, 12)
        rows += [(2 * k, a.tolist(), k), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), k)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.vector_links(df).collect()}
    assert got == vectors_by_brute_force(rows) and 0 < sum(n for n, _ in got.values()) < len(rows)


def test_vectors_that_share_an_id(spark):
    base = np.eye(8)
    near = lambda k: (base[k] + 0.01 * base[7]).tolist()
    rows = [(5, base[0].tolist(), 0), (5, base[1].tolist(), 0), (2, near(0), 0), (9, near(1), 0), (5, base[2].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_links(df).collect())
    assert got == [(2, 1, 2, True), (5, 0, 5, True), (5, 1, 2, False), (5, 1, 5, True), (9, 1, 5, False)]


@pytest.mark.parametrize("size", [1, 2, 100])
def test_groups_of_sorted_rows(size):
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"a": [1, 1, 1, 2, 2, 3], "b": [0, 0, 1, 1, 1, 1], "v": list(range(6))})
    got = [t.column("v").to_pylist() for t in vector_dedup.groups_of((rows.slice(k, size) for k in range(0, 6, size)), 2)]
    assert got == [[0, 1], [2], [3, 4], [5]]


def test_op9(spark, small):
    rows = [tuple(r) for r in table(spark, small, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.op9_subspace_pigeonhole(spark, small).collect()}
    assert got == vectors_by_brute_force(rows)
