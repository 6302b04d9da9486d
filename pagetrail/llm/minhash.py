"""MinHash near-deduplication with sequential Bayesian verification.

Signatures are cut into bands; equal bands make candidates. Candidates are gathered through their
groups, not as pairs: a bucket links each member to its smallest one, and what hangs together that
way is compared in one task, or chunk by chunk in several where a group is large. A task takes the
pairs that share a band, compares their signatures batch by batch, and drops a pair as soon as the
posterior probability that its similarity reaches the threshold is under a batch's part of `miss`. Survivors are
verified exactly on their full shingle sets, the likeliest first, unless they hang together already.
Only links leave the task, fewer than there are documents in it.

Equal sets form a class, of which the smallest id alone is compared. A pair at the threshold is
missed by the bands with probability `miss` at most, and by the pruning with `miss` at most.

Defined results: null and empty texts, and those of white space, have no shingles and link with
nothing; with fewer words than a shingle has, the whole sequence is the one shingle; a null id links
with nothing; repeated rows are equal sets; rows that share an id but not a text each link by their own; an empty table gives an empty result; other columns are
not read by `near_links` and carried along by `near_dedup`.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm.batches import give_back, pieces
from pagetrail.llm.bloom import joined_few, probed
from pagetrail.llm.components import components
from pagetrail.llm.hashing import mixed, word_hashes
from pagetrail.llm.shared import table, written

ROWS, MISS, CHUNK = 5, 1e-6, 1000


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes, ascending, of the runs of so many words; A-Z is lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    w = word_hashes(raw)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def bands_for(similarity: float, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**ROWS))


@functools.cache
def _multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 31, hashes, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, hashes, np.uint32)


def signature(shingle: np.ndarray, hashes: int) -> np.ndarray:
    a, b = _multipliers(hashes)
    low, out = (shingle >> np.uint64(32)).astype(np.uint32), np.full(hashes, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        out = np.minimum(out, (a[:, None] * low[None, i : i + 1024] + b[:, None]).min(axis=1))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key a band, the band's number mixed in."""
    parts = sig.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return h.view(np.int64)


def least_matches(hashes: int, similarity: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) after each batch of a signature.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m). A pair at t has
    m of n at most with a probability up to 1 / (1 - t) times that, and may be dropped by every batch:
    each gets such a part of `miss` that all of them together stay under it.
    """
    out, batches = [], range(4 * ROWS, hashes + 1, 4 * ROWS)
    part = miss * (1 - similarity) / max(1, len(batches))
    for n in batches:
        total, m = 0.0, -1
        while total < part:
            m += 1
            total += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append((n, m))
    return out


def linked(ids: list[int], texts: list[str], sides: list[int], cross: bool, words: int, percent: int, hashes: int) -> list[tuple[int, int]]:
    """Links (id, id) that join all documents of this task that hang together by verified links.

    cross: only pairs from different sides count.
    """
    sets = [shingles(t, words) for t in texts]
    sigs = np.stack([signature(s, hashes) for s in sets])
    keys = np.stack([band_keys(s) for s in sigs])
    side, sizes, n = np.array(sides), np.array([len(s) for s in sets]), len(ids)
    candidate = np.zeros((n, n), bool)
    for k in range(keys.shape[1]):
        candidate |= keys[:, k][:, None] == keys[:, k][None, :]
    i, j = np.nonzero(np.triu(candidate, 1))
    del candidate
    fine = np.minimum(sizes[i], sizes[j]) * 100 >= percent * np.maximum(sizes[i], sizes[j])
    if cross:
        fine &= side[i] != side[j]
    i, j = i[fine], j[fine]
    matches, done = np.zeros(len(i), np.int64), 0
    for upto, least in least_matches(hashes, percent / 100):
        for part in range(0, len(i), 100_000):
            cut = slice(part, part + 100_000)
            matches[cut] += (sigs[i[cut], done:upto] == sigs[j[cut], done:upto]).sum(axis=1)
        alive, done = matches >= least, upto
        i, j, matches = i[alive], j[alive], matches[alive]
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    order = np.argsort(-matches, kind="stable")
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        p, q = find(a), find(b)
        if p == q:
            continue
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[max(p, q)] = min(p, q)
            out.append((ids[a], ids[b]))
    return out


def near_links(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document."""
    bands = bands_for(percent / 100, miss)
    hashes = bands * ROWS
    hashes += -hashes % (4 * ROWS)  # whole batches

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, 1):
            n, keys, sets = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(signature(s, hashes))[:bands] if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = written(rows.mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    classes = written(sketched.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = sketched.join(classes, (sketched["set_key"] == classes["set_key"]) & (sketched["doc_id"] == classes["rep"]), "left_semi")
    posted = written(reps.dropDuplicates(["set_key"]).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")), "bands")
    buckets = posted.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most").select("key", "least")
    stars = posted.join(buckets, "key").filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    groups = written(components(stars), "groups")

    # a group larger than a chunk is compared chunk by chunk
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    dealt = groups.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("node", "component", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    # few texts are in a group: the others stay where they are, as long as the filter can tell
    maybe = probed(rows, "doc_id", groups.select("node"), "node").filter("maybe")
    texts = maybe.hint("merge").join(dealt, F.col("doc_id") == F.col("node")).select("component", "low", "high", "chunk", "doc_id", "text")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def links(group, key):
            ids, sides, texts_ = zip(*{(row[0], row[2]): row for row in group}.values(), strict=True)
            return linked(list(ids), list(texts_), list(sides), key[1] != key[2], words, percent, hashes)

        key, group = None, []
        for batch in batches:
            out = []
            for component, low, high, side, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (component, low, high) != key:
                    if len(group) > 1:
                        out += links(group, key)
                    key, group = (component, low, high), []
                group.append((doc_id, side, text))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), ()))], ["a", "b"])
        out = links(group, key) if len(group) > 1 else []
        del group
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), ()))], ["a", "b"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = texts.repartition(n, "component", "low", "high").sortWithinPartitions("component", "low", "high")
    links = written(tasks.mapInArrow(compare, "a long, b long"), "links")
    joined = components(links)

    final = classes.join(joined, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    known = sketched.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "set_key").join(final, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = sketched.filter("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs of which one of each group stays, with their own columns."""
    gone = near_links(docs, words, percent, id_col, text_col, **how).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    keyed = docs.withColumn("__gone", F.col(id_col).cast("long"))
    return joined_few(keyed, written(gone, "gone"), ["__gone"], "left_anti").select(*docs.columns)


def op6_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "documents"), words=3, percent=85)


QUERIES = {"op6_minhash_bayes": op6_minhash_bayes}
#: By brute force: all pairs that share a shingle, then reachability; for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS both_ FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  WHERE 100 * both_ >= 85 * (m + n - both_)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce(b, doc_id)) AS BIGINT) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM s LEFT JOIN c ON a = doc_id
"""
ORACLES = {"op6_minhash_bayes": SQL}
