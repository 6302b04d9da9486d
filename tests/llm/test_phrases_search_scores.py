"""Phrases, ranked search and class-based scores against brute force, with odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.llm import brown, collocations, lexical
from pagetrail.llm.varint import packed, unpacked

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PASSAGE = " ".join(f"p{k}" for k in range(40))
TEXTS = [
    (1, None, "en"), (2, "", "en"), (3, " .,; \n", None), (4, "The red fox. the RED fox, the red\tfox", "en"), (5, "the red fox", None), (5, "the red fox", None), (None, "the red fox ran", "und"),
    (6, "a b a b a b a b a b a b", "en"), (7, f"x y {PASSAGE} z", "en"), (8, f"{PASSAGE}! the red fox", "en"), (9, f"{PASSAGE} the", "en"), (10, "É é é ÀÉ the\0red", "fr"), (11, "lonely " * 3000, "fr"), (12, "the red fox\rthe red cat;the red dog", "en"), (12, "other", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, 1, "k", 0) for i, t, g in TEXTS], "doc_id long, text string, lang string, n int, gram string, term int").repartition(3)


def contained(short, long_):
    return any(long_[i : i + len(short)] == short for i in range(len(long_) - len(short) + 1))


def brute_phrases(rows, longest, least, top, cover):
    total, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {g: c for g, c in f.items() if c >= least and len(g[1]) > 1}
    out = defaultdict(list)
    for (lang, g), a in often.items():
        if any(x[0] == lang and len(x[1]) > len(g) and 100 * b >= cover * a and contained(g, x[1]) for x, b in often.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("how", [{}, {"least": 3, "bits": 8}, {"least": 2, "bits": 8}, {"longest": 2}, {"longest": 6, "cover": 100}, {"top": 4}])
def test_phrases(spark, docs, how):
    how = {"longest": 4, "least": 2, "top": 2000, "cover": 80} | how
    got = sorted(map(tuple, collocations.phrases(docs, **how).collect()))
    assert got == brute_phrases(TEXTS, *(how[k] for k in ("longest", "least", "top", "cover")))


def test_paths_are_compact(spark, docs):
    edges = spark.createDataFrame([("en", f"p{k} p{k + 1} p{k + 2} p{k + 3}", 3) for k in range(37)] + [("en", "a b a b", 5), ("en", "b a b a", 5), ("de", "p0 p1 p2 p3", 3)], "lang string, gram string, f long")
    nodes = spark.createDataFrame([("en", f"p{k} p{k + 1} p{k + 2}", 3) for k in range(38) if k != 20] + [("en", "p20 p21 p22", 4), ("en", "a b a", 5), ("en", "b a b", 5)], "lang string, gram string, f long")
    got = sorted((r.lang, " ".join(r.words), r.weight) for r in collocations.paths(edges, nodes, 4).collect())
    first, second = (" ".join(f"p{k}" for k in ks) for ks in (range(23), range(20, 40)))
    assert got == sorted([("de", "p0 p1 p2 p3", 3), ("en", first, 3), ("en", second, 3), ("en", "a b a b", 5), ("en", "b a b a", 5)])


def test_no_phrases_without_rows(spark, docs):
    assert collocations.phrases(docs.limit(0), least=1).count() == 0
    assert collocations.phrases(docs.filter("doc_id < 3"), least=1).count() == 0


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, 1 << 28, (1 << 42) + 5, 7], np.int64)
    raw, at = packed(values)
    assert unpacked(raw.tobytes()).tolist() == values.tolist() and at[-1] == len(raw) and unpacked(b"").tolist() == []


def brute_search(rows, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(term.findall((t or "").translate(LOW)))) for i, t, *_ in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(term.findall((text or "").translate(LOW)))
    out = []
    for item, words in asked.items():
        hits = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if score > 0:
                hits.append((-score, i is not None, i or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "the red fox"), (2, None), (3, "nowhere"), (4, "É ÀÉ the"), (5, "p1 p2 p3 fox lonely b"), (1, "p5"), (None, "a b"), (6, "THE the The")]


@pytest.mark.parametrize("how", [(8 << 20, 256, 50), (1, 1, 2), (300, 2, 3)])
def test_search(spark, docs, how):
    shard, group, k = how
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, doc_id int")
    index = lexical.build_index(docs, shard_bytes=shard)
    assert sorted(map(tuple, lexical.search(index, items, k, group=group).collect()), key=repr) == brute_search(TEXTS, ITEMS, k)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.build_index(docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.build_index(docs.filter("doc_id < 4")), items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.limit(0)).count() == 0


def test_bounds_leave_blocks_closed():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [(b"common " * int(rng.integers(1, 4)) + b"often " * int(i % 3 == 0) + b"rare " * 9 * int(i < 60)).strip() for i in range(20_000)]
    rows = lexical.shard_rows(pa.array(np.arange(len(texts))), texts, 0).to_pylist()
    shard = lexical.Shard(rows[0]["payload"], rows[0]["n"], rows[0]["words"])
    for word in ("common", "often", "rare"):
        blocks = [(r["most"], r["least"], r["first"], r["last"], r["payload"]) for r in rows if r["term"] == word]
        df = sum(r["n"] for r in rows if r["term"] == word)
        weight = math.floor(1000 * math.log((2 * rows[0]["n"] + 2) / (2 * df + 1)))
        bound = max(int(weight * shard.share(np.array([b[0]]), shard.norm_of(np.array([b[1]])))[0]) for b in blocks)
        shard.add(weight, bound, [1], blocks)
    docs_, scores = shard.hits(1, 50)
    want = brute_search([(i, t.decode()) for i, t in enumerate(texts)], [(1, "common often rare")], 50)
    assert sorted(zip([1] * 50, range(1, 51), docs_.tolist(), scores.tolist(), strict=True), key=repr) == want
    assert shard.opened * 10 < shard.blocks


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w] + [""]


def check_base(rows, got):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows]
    c = Counter(w for (_, t, *_), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, t, *_), h in zip(rows, held, strict=True) for w in [tokens(t)])
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


@pytest.mark.parametrize("how", [{}, {"least": 2, "classes": 3, "sweeps": 3}, {"least": 1, "movable": 2, "classes": 2}])
def test_scores_of_odd_rows(spark, docs, how):
    got = brown.scored(docs, **how).collect()
    check_base(TEXTS, got)
    assert all(math.isfinite(r.score) and r.score < 0 and r.perplexity > 1 for r in got)
    assert brown.scored(docs.limit(0), **how).count() == 0
    only_held = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in brown.scored(only_held, **how).collect())


def test_scores(spark, middle):
    table = spark.read.parquet(f"{middle}/documents.parquet")
    got = brown.scored(table).collect()
    check_base([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)  # both negative
    other = {r.doc_id: r.score for r in brown.scored(table.repartition(7)).collect()}
    assert all(math.isclose(r.score, other[r.doc_id], rel_tol=1e-9) for r in got)


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    counts = np.r_[5, rng.integers(1, 40, 200)]  # the end first
    slots = np.r_[-1, np.where(counts[1:] >= 10, np.cumsum(counts[1:] >= 10) - 1, -1)]
    of_slot = rng.integers(0, 6, int(slots.max()) + 1)
    for once in (int((counts == 1).sum()), 0):
        use = np.ones(len(counts), bool) if once else counts != 1
        c, s = counts[use], slots[use]
        size = 6 + brown.RARE + 1
        empty = brown.ClassModel(of_slot, np.zeros((size, size), np.int64), 6, once, int((c == 2).sum()))
        of = empty.class_of(s, c)
        sequence = rng.permutation(np.repeat(of, c))
        bigrams = np.zeros((size, size), np.int64)
        np.add.at(bigrams, (np.r_[sequence[-1], sequence[:-1]], sequence), 1)
        model = brown.ClassModel(of_slot, bigrams, 6, once, int((c == 2).sum()))
        c, s = np.r_[c, 0], np.r_[s, -1]  # and the unknown word
        of = model.class_of(s, c)
        for before in set(of.tolist()):
            empty_classes = np.setdiff1d(np.arange(size), of)  # no word is in these
            total = (10 ** (model.after[before, of] + model.within(of, c))).sum() + (10 ** model.after[before, empty_classes]).sum()
            assert math.isclose(total, 1, rel_tol=1e-9)


def test_a_move_is_the_best_one():
    rng = np.random.default_rng(4)
    words, classes = 12, 3
    size = classes + brown.RARE + 1
    pairs = Counter((int(a), int(b)) for a, b in rng.integers(0, words, (400, 2)) if a != b)
    own = rng.integers(0, classes, words)

    def total(of):
        m = np.zeros((size, size))
        for (a, b), n in pairs.items():
            m[of[a], of[b]] += n
        return brown.likelihood(m), m.astype(np.int64)

    _, bigrams = total(own)
    for w in range(words):
        entries = Counter()
        for (a, b), n in pairs.items():
            if a == w:
                entries[int(own[b])] += n
            if b == w:
                entries[int(own[a]) + size] += n
        other = np.array(sorted(entries))
        got = brown.best_classes(np.zeros(len(other), np.int64), other, np.array([entries[o] for o in other]), own[w : w + 1], bigrams, classes)[0]
        tried = own.copy()
        tried[w] = got
        assert total(tried)[0] >= total(own)[0] - 1e-6  # never worse, neighbours staying where they are
