"""Phrases whose words go together, from a weighted graph of overlapping phrases.

The graph of each language has the phrases of `longest` - 1 words as nodes and those of `longest` words as
edges, from the node of their first words to that of their last, weighted by occurrences. A place where a
piece of text ends before an edge is complete counts for the shorter phrase that is left there (the
correction at ends). So the count of a phrase is the flow out of its node: the weights of all edges and
ends that begin with it. No shorter phrase is counted by itself.

1. Pairs of words are counted by a hash. What can hold no phrase of `least` occurrences, because a pair
   within it has fewer, needs no edge: a piece is treated as if it ended there. The frequent hashes go to
   the tasks as a filter of fixed size; a pair that passes it by mistake only costs work.
2. Every place of a text gives one row, its edge or the shorter phrase up to the end; rows are summed in
   the task that read them and then over all. Flows follow from the longest to the shortest.
3. Edges that follow one another with the whole flow of the node between them are one path (found by
   pointer doubling), which is as rare or frequent as each of its edges: phrases inside longer ones are
   found along paths instead of edge by edge.
4. Each phrase is cut in all ways; counts of both parts are joined; of a language only the best of each
   of many parts meet in one task.

Defined results: null text counts as empty, null lang as `und`; texts without words give nothing; rows
that repeat count each; phrases of equal score go by count and then by UTF-8 bytes; a text of any length
is one row's work; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.llm.batches import pieces
from pagetrail.llm.hashing import mixed
from pagetrail.llm.shared import table, written
from pagetrail.llm.words import Words, binary_texts, byte_set

LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
#: Places of the filter of frequent pairs, as a power of two: 8 MB whatever the corpus.
PLACE_BITS = 26
#: Bytes of text that a task scans at a time: the numbers of its places take some thirty times as much.
SCAN_BYTES = 2 << 20
ENDS = byte_set(b".,;:!?\n\x0b\x0c\r")
APART = ENDS | byte_set(b" \t")


class _Scan:
    """The words of a batch of (lang, text) with their language and what follows them in the same piece."""

    def __init__(self, batch):
        import pyarrow as pa

        coded = batch.column(0).cast(pa.binary()).fill_null(b"und").dictionary_encode()
        self.langs = coded.dictionary
        self.words = Words(binary_texts(batch.column(1)), APART)
        self.lang = coded.indices.to_numpy().astype(np.int64)[self.words.texts]
        piece = np.cumsum(ENDS[self.words.data], dtype=np.int32)[self.words.start] if len(self.words.start) else self.words.start
        self.followed = np.zeros(len(piece), bool)
        self.followed[:-1] = (piece[1:] == piece[:-1]) & (self.words.texts[1:] == self.words.texts[:-1])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that another follows, and the hash of the two in their language."""
        import zlib

        at = np.flatnonzero(self.followed)
        h = self.words.hashes()[self.words.code] if len(at) else np.zeros(0, np.uint64)
        lang = np.array([zlib.crc32(x) for x in self.langs.to_pylist()], np.uint64)
        return at, mixed(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + lang[self.lang[at]])


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """(h, n): occurrences of pairs of words by hash."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, 1, SCAN_BYTES):
            h, n = np.unique(_Scan(batch).pairs()[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def pair_filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """2^bits places as bytes of eight, two set for each h."""
    h = F.col("h")
    place = F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND(F.lit((1 << bits) - 1))))
    word = frequent.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("set"))
    got = word.toArrow()  # 2^(bits - 5) rows at most
    out = np.zeros(1 << bits - 5, np.uint32)
    out[got.column("word").to_numpy()] = got.column("set").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


GRAM = "lang string, size int, gram string, n long"


def edge_counts(texts: DataFrame, frequent: np.ndarray, longest: int, bits: int) -> DataFrame:
    """(lang, size, gram, n): the longest phrase from each place on, of `longest` words or up to an end."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known = shared.value
        for batch in pieces(batches, 1, SCAN_BYTES):
            s = _Scan(batch)
            code = s.words.code
            if not len(code):
                continue
            follows = np.zeros(len(code), bool)
            at, h = s.pairs()
            hit = np.ones(len(at), bool)
            for p in _places(h, bits):
                hit &= known[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 == 1
            follows[at[hit]] = True
            key = code * len(s.langs) + s.lang
            width = len(s.words.distinct) * len(s.langs)
            alive, ids = np.arange(len(code)), key
            for size in range(1, longest + 1):
                goes_on = follows[alive + size - 1] if size < longest else np.zeros(len(alive), bool)
                _, first, count = np.unique(ids[~goes_on], return_index=True, return_counts=True)
                place = alive[~goes_on][first]
                words = [s.words.strings(code[place + k]) for k in range(size)]
                gram = pc.binary_join_element_wise(*words, " ") if size > 1 else words[0]
                lang = s.langs.take(pa.array(s.lang[place])).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(place), size, np.int32)), gram, pa.array(count.astype(np.int64))], ["lang", "size", "gram", "n"])
                alive, ids = alive[goes_on], ids[goes_on]
                if not len(alive):
                    break
                if size < longest:
                    ids = np.unique(ids, return_inverse=True)[1]  # numbers of phrases of this size: small
                    ids = ids * width + key[alive + size]

    return texts.mapInArrow(run, GRAM).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def flows(edges: DataFrame, longest: int) -> dict[int, DataFrame]:
    """(lang, gram, f) of each size: what flows out of a node is the weight of what begins with it, ends included."""
    found = {longest: edges.filter(F.col("size") == longest).select("lang", "gram", F.col("n").alias("f"))}
    for size in range(longest - 1, 0, -1):
        longer = found[size + 1].select("lang", F.substring_index("gram", " ", size).alias("gram"), "f")
        ends = edges.filter(F.col("size") == size).select("lang", "gram", F.col("n").alias("f"))
        found[size] = written(longer.unionByName(ends).groupBy("lang", "gram").agg(F.sum("f").alias("f")), f"flow-{size}")
    return found


def _chains(steps: DataFrame, all_: DataFrame) -> DataFrame:
    """(e, head, at): of every edge the first one of its path and the steps from there; steps(e, up) name the edge before.

    Pointer doubling; edges on a cycle have no first one and are paths by themselves.
    """
    pending = written(steps.withColumn("steps", F.lit(1)), "steps")
    done = written(all_.join(pending, "e", "left_anti").select("e", F.col("e").alias("head"), F.lit(0).alias("at")), "heads")
    while True:
        above = done.select(F.col("e").alias("up"), "head", F.col("at").alias("more"), F.lit(None).cast(steps.schema["up"].dataType).alias("next"))
        above = above.unionByName(pending.select(F.col("e").alias("up"), F.lit(None).cast(steps.schema["up"].dataType).alias("head"), F.col("steps").alias("more"), F.col("up").alias("next")))
        met = written(pending.join(above, "up").select("e", "head", "next", (F.col("steps") + F.col("more")).alias("at")), "met")
        new = met.filter("head IS NOT NULL").select("e", "head", "at")
        if new.limit(1).count() == 0:
            return done.unionByName(pending.select("e", F.col("e").alias("head"), F.lit(0).alias("at")))
        done, pending = done.unionByName(new), met.filter("head IS NULL").select("e", F.col("next").alias("up"), F.col("at").alias("steps"))


def paths(edges: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """(lang, words, weight): edges(lang, gram, f), compacted where the whole flow of nodes(lang, gram, f) goes from one to the next."""
    e = edges.select(F.struct("lang", "gram").alias("e"), "lang", "gram", "f")
    node = nodes.select(F.col("lang").alias("l"), F.col("gram").alias("node"), F.col("f").alias("through"))

    def whole(end: Column, into: str) -> DataFrame:  # one edge a node at most
        return e.join(node, (F.col("lang") == F.col("l")) & (end == F.col("node")) & (F.col("f") == F.col("through"))).select("l", "node", F.col("e").alias(into))

    into, out = whole(F.substring_index("gram", " ", 1 - longest), "up"), whole(F.substring_index("gram", " ", longest - 1), "e")
    chained = _chains(into.join(out, ["l", "node"]).select("e", "up"), e.select("e"))
    placed = chained.join(e.select("e", "f"), "e").select(F.col("head.lang").alias("lang"), F.col("head.gram").alias("head"), "at", F.substring_index("e.gram", " ", -1).alias("word"), "f")
    # a path is no longer than the text that it stands in
    later = F.filter(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["at"] > 0)
    made = placed.groupBy("lang", "head").agg(later.alias("later"), F.max("f").alias("weight"))
    return made.select("lang", F.concat(F.split("head", " "), F.col("later.word")).alias("words"), "weight")


def windows(words: Column, size: int) -> Column:
    """All phrases of so many words in an array of words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, size), " "))


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER, bits: int = PLACE_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` phrases of 2 to `longest` words of each language.

    score: floor(2,000,000 * a / (l + r)) at the cut where that is least. A phrase that lies in a longer one
    with at least `cover` percent of its occurrences is left out.
    """
    texts = _texts(docs, lang_col, text_col)
    frequent = written(pair_counts(texts).filter(F.col("n") >= least).select("h"), "pairs")
    edges = written(edge_counts(texts, pair_filter(frequent, bits), longest, bits), "edges")
    flow = flows(edges, longest)
    often = {size: f.filter(F.col("f") >= least) for size, f in flow.items()}
    long_ = written(paths(often[longest], flow[longest - 1], longest), "paths")

    def along(size: int) -> DataFrame:
        return long_.select("lang", F.explode(windows(F.col("words"), size)).alias("phrase"), F.col("weight").alias("f"))

    found = [along(longest).select("lang", "phrase", F.lit(longest).alias("size"), F.col("f").alias("a"))]
    found += [often[s].select("lang", F.col("gram").alias("phrase"), F.lit(s).alias("size"), F.col("f").alias("a")) for s in range(2, longest)]
    candidates = written(reduce(DataFrame.unionByName, found), "candidates")

    around = [along(s) for s in range(2, longest)]
    for s in range(3, longest):
        split = often[s].select("lang", F.split("gram", " ").alias("words"), "f")
        around += [split.select("lang", F.explode(windows(F.col("words"), k)).alias("phrase"), "f") for k in range(2, s)]
    inside = reduce(DataFrame.unionByName, around).groupBy("lang", "phrase").agg(F.max("f").alias("f")) if around else None
    kept = candidates
    if inside is not None:
        by = (candidates["lang"] == inside["lang"]) & (candidates["phrase"] == inside["phrase"])
        wide = "decimal(38,0)"
        kept = candidates.join(inside, by & (F.lit(100).cast("int") * inside["f"].cast(wide) >= F.lit(cover) * candidates["a"].cast(wide)), "left_anti")

    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    parts = reduce(DataFrame.unionByName, [often[s] for s in range(1, longest)])
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("gram").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(18,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(38,0))) AS BIGINT)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(n))  # `top` rows of each part meet in one task
    first = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = edges.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_de_bruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS INTEGER) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k)),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM g WHERE k >= 2),
d AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.k > c.k AND contains(' ' || o.g || ' ', ' ' || c.g || ' ') AND 100::HUGEINT * o.f >= 80::HUGEINT * c.f)),
u AS (SELECT d.*, j, array_to_string(string_split(d.g, ' ')[1:j], ' ') AS lg, array_to_string(string_split(d.g, ' ')[j + 1:], ' ') AS rg FROM d, (VALUES (1), (2), (3)) t(j) WHERE j < k),
b AS (SELECT u.lang, u.g, u.f AS a, l.f AS l, r.f AS r, j, CAST((2000000::HUGEINT * u.f) // (l.f + r.f) AS BIGINT) AS score
      FROM u JOIN g l ON l.lang = u.lang AND l.g = lg JOIN g r ON r.lang = u.lang AND r.g = rg),
m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM m)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""
QUERIES = {"op11_de_bruijn_phrases": op11_de_bruijn_phrases}
ORACLES = {"op11_de_bruijn_phrases": SQL}
