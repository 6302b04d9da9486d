"""Keywords that go together, and those that go with a page, exactly: no bound on partners.

A page has at most k keywords, so the product of pages and partners is sparse, but a popular keyword has many pages
and many partners. Pages are taken in blocks of a bounded number. A block receives each list of partners that
some page of it needs once, in parts by partner, so a keyword of all pages is dealt over all blocks and parts. A task
reads the candidates of a block and part in ascending order, sums whole millionths, and keeps the k best of each page.

Defined results: ties go by term; weights may be negative; a term of the page itself is never related to it; null
terms are no keywords, rows that repeat count once, a null id is a page; a keyword without partners brings nothing;
empty tables give no rows. Memory is bounded by a block's pages times k, a long text has more rows only.
Joins whose sides grow with the corpus are hinted to merge: Spark guesses their sizes from files of a few bytes a row,
before lists become rows, and would collect tens of millions of rows in the driver for a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.operators.files import frequent
from pagetrail.sources import versions
from pagetrail.sources.scratch import fresh_path, written

#: Blocks hold a sixteenth of the pages, but no fewer than PAGES and no more than MOST; a list is sent once to each.
PAGES, MOST, BLOCKS, PARTS, PASSES = 2048, 1 << 15, 16, 8, 4
#: Contributions, candidates, and pairs of candidate and page that are summed at once.
SUMMED, CANDIDATES, CELLS = 1 << 19, 256, 1 << 19
#: Candidates that wait for the next choice of the best, or half as many as there are best ones.
WAITING = 1 << 17


def keyword_partners(direct: DataFrame, least: int = 2) -> DataFrame:
    """a, b, pmi: all keywords b that go with keyword a on `least` pages or more, and their pointwise mutual information.

    A page of k keywords gives k * (k - 1) / 2 pairs, counted where they are made before they are shuffled.
    """
    words = direct.filter("term IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_set("term")).alias("words"))
    words = written(words.select("words"), "words")
    n = words.agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row
    on = words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("pages"))
    pairs = words.select("words", F.posexplode("words").alias("at", "a")).select("a", F.explode(F.expr("slice(words, at + 2, size(words))")).alias("b"))
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= least)
    known = both.join(on.select(F.col("term").alias("a"), F.col("pages").alias("on_a")).hint("merge"), "a").join(on.select(F.col("term").alias("b"), F.col("pages").alias("on_b")).hint("merge"), "b")
    pmi = F.round(F.log(F.col("both") * F.col("n") / (F.col("on_a").cast("double") * F.col("on_b"))), 6)
    half = known.crossJoin(F.broadcast(n)).select("a", "b", pmi.alias("pmi"))
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return half.select("pmi", F.inline(ends)).select("a", "b", "pmi")


def vocabulary(partners: DataFrame) -> DataFrame:
    """term, key: numbers that ascend with the terms, written."""
    terms = partners.select(F.col("a").alias("term")).unionByName(partners.select(F.col("b").alias("term"))).distinct()
    return written(terms.repartitionByRange("term").sortWithinPartitions("term").withColumn("key", F.monotonically_increasing_id()), "vocabulary")


def numbered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows(id, term) as id, key; rows of frequent terms, 200 terms at most, stay where they are read."""
    few = frequent(rows, col="term")
    hot = F.col("term").isin(few)
    met = rows.filter(hot).join(F.broadcast(words.filter(hot)), "term").select("id", "key")
    return met.unionByName(rows.filter(~hot).join(words.hint("merge"), "term").select("id", "key"))


def related_weights(direct: DataFrame, page_terms: DataFrame, partners: DataFrame, k: int, size: int | None = None, parts: int = PARTS, most: int = BLOCKS * PAGES) -> DataFrame:
    """id, term, weight: the k best candidates of each page and part, of which the k best of a page are chosen.

    What a step makes is written, so its shuffle files go before the next one. From `most` pages on the parts
    are taken in passes, so only the lists of a pass are on disk at once.
    """
    spark = direct.sparkSession
    at = fresh_path(spark, "product")
    words = vocabulary(partners)
    pages = written(numbered(direct.select("id", "term"), words).groupBy("id").agg(F.collect_set("key").alias("keys")), "keys", at)
    n = pages.count()
    size = size or min(max(PAGES, -(-n // BLOCKS)), MOST)
    pages = written(pages.coalesce(max(1, n // size)).withColumn("row", F.monotonically_increasing_id()), "pages")
    inside = (F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) % size).cast("int")  # rows of a partition are numbered below 2^33
    placed = pages.select("id", "keys", (F.col("row") - inside).alias("block"), inside.alias("page"))
    none, zero = F.lit(-1).cast("long"), F.lit(0).cast("long")
    part_of = F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int").alias("part")

    here = placed.select(F.col("id").alias("__id"), "block", "page")
    own = numbered(page_terms.select("id", "term"), words).join(here, F.col("id").eqNullSafe(F.col("__id"))).select("block", F.col("key").alias("b"), "page")
    own = written(own, "own", at).select("block", part_of, "b", none.alias("a"), "page", zero.alias("micros"))
    keyed = partners.join(words.select(F.col("term").alias("a"), F.col("key").alias("ka")).hint("merge"), "a").join(words.select(F.col("term").alias("b"), F.col("key").alias("kb")).hint("merge"), "b")
    keyed = keyed.select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.round(F.col("pmi") * 1_000_000).cast("long").alias("micros"))
    keyed = written(keyed, "partners", at).withColumn("part", part_of)

    def candidates(of: list[int]) -> DataFrame:
        """The k best of each page in each of these parts."""
        every, here = F.explode(F.array(*map(F.lit, of))).alias("part"), F.col("part").isin(of)
        kept = placed.select("block", "page", F.explode("keys").alias("a"), none.alias("b"))
        kept = kept.select("block", every, "b", "a", "page", zero.alias("micros"))
        wanted = placed.select("block", F.explode("keys").alias("a")).distinct().select("block", "a", every)
        lists = wanted.join(keyed.filter(here).hint("merge"), ["a", "part"]).select("block", "part", "b", "a", F.lit(-1).alias("page"), "micros")
        stream = kept.unionByName(own.filter(here)).unionByName(lists).repartition("block", "part").sortWithinPartitions("block", "part", "b")
        return stream.mapInArrow(best_of_blocks(k), "block long, page int, b long, micros long")

    if n < most:
        best = candidates(list(range(parts)))
    else:
        best = reduce(DataFrame.unionByName, [written(candidates(list(range(first, parts, PASSES))), "candidates") for first in range(min(parts, PASSES))])
        versions.remove(spark, at)
    found = best.join(placed.select("id", "block", "page"), ["block", "page"]).join(words.select(F.col("key").alias("b"), "term").hint("merge"), "b")
    return found.select("id", "term", F.round(F.col("micros") / 1_000_000, 6).alias("weight"))


def best_of_blocks(k: int):
    """A function of sorted batches: first a group's keywords by page (b is -1), then for each b partners (a, micros) and pages that hold it."""

    def run(batches: Iterator):
        import pyarrow as pa

        names = ("block", "part", "b", "a", "page", "micros")
        block, left = None, None
        for arrow in batches:
            rows = {n: arrow.column(arrow.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
            change = np.flatnonzero((np.diff(rows["block"]) != 0) | (np.diff(rows["part"]) != 0)) + 1
            for low, high in zip([0, *change], [*change, arrow.num_rows], strict=True):
                if low == high:
                    continue
                name = (rows["block"][low], rows["part"][low])
                if block is None or block != name:
                    if left is not None:
                        yield from out(pa, block[0], left.end())
                    block, left = name, Block(k)
                left.add(rows["b"][low:high], rows["a"][low:high], rows["page"][low:high], rows["micros"][low:high])
        if left is not None:
            yield from out(pa, block[0], left.end())

    def out(pa, block: int, best: tuple):
        page, b, micros = best
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(page), block, np.int64)), pa.array(page.astype(np.int32)), pa.array(b), pa.array(micros)], ["block", "page", "b", "micros"])

    return run


class Block:
    """The k best candidates of each page of a block so far."""

    def __init__(self, k: int):
        self.k, self.ready = k, False
        self.parts: list[tuple] = []  # rows whose candidate may go on in the next batch
        empty = np.zeros(0, np.int64)
        self.best, self.waiting, self.waits = (empty, empty, empty), [], 0

    def add(self, b, a, page, micros) -> None:
        self.parts.append((b, a, page, micros))
        if sum(len(p[0]) for p in self.parts) >= 1 << 14 and self.parts[0][0][0] != b[-1]:
            b, a, page, micros = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            cut = np.searchsorted(b, b[-1])
            self.parts = [(b[cut:], a[cut:], page[cut:], micros[cut:])]
            self.take(b[:cut], a[:cut], page[:cut], micros[:cut])

    def end(self) -> tuple:
        if self.parts:
            self.take(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
        self.choose()
        return self.best

    def take(self, b, a, page, micros) -> None:
        first = np.searchsorted(b, 0)
        if first:
            order = np.argsort(a[:first], kind="stable")
            self.words, self.starts = np.unique(a[:first][order], return_index=True)
            self.pages = page[:first][order].astype(np.int64)
            self.counts = np.diff(np.append(self.starts, first))
            self.width = int(self.pages.max()) + 1
            self.least, self.ready = np.full(self.width, np.iinfo(np.int64).min), True
        if not self.ready:
            return  # pages without keywords have no candidates
        b, a, page, micros = b[first:], a[first:], page[first:], micros[first:]
        if not len(b):
            return
        fresh = np.append(True, b[1:] != b[:-1])
        number, names = np.cumsum(fresh) - 1, b[fresh]
        listed = a >= 0
        at = np.searchsorted(self.words, a[listed])
        size = np.zeros(len(b), np.int64)
        size[listed] = self.counts[at]
        where = np.zeros(len(b), np.int64)
        where[listed] = self.starts[at]
        before = (np.cumsum(size) - size)[fresh]  # contributions before each candidate
        step = np.maximum.accumulate(before // SUMMED + np.arange(len(names)) // max(1, min(CANDIDATES, CELLS // self.width)))
        cuts = np.flatnonzero(np.diff(step)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(names)], strict=True):
            x, y = np.searchsorted(number, [low, high])
            self.sum(names[low:high], number[x:y] - low, listed[x:y], where[x:y], size[x:y], page[x:y], micros[x:y])

    def sum(self, names, number, listed, where, size, page, micros) -> None:
        total = int(size.sum())
        if not total:
            return
        ends = np.cumsum(size)
        each = np.repeat(np.arange(len(size)), size)
        cell = number[each] * self.width + self.pages[where[each] + np.arange(total) - (ends - size)[each]]
        cells = len(names) * self.width
        met = np.bincount(cell, minlength=cells) > 0
        held = ~listed & (page < self.width)
        met[number[held] * self.width + page[held]] = False
        weight = np.bincount(cell, micros[each], cells).astype(np.int64)  # whole numbers below 2^53
        found = np.flatnonzero(met & (weight.reshape(-1, self.width) > self.least).ravel())
        self.waiting.append((found % self.width, names[found // self.width], weight[found]))
        self.waits += len(found)
        if self.waits >= max(WAITING, len(self.best[0]) // 2):
            self.choose()

    def choose(self) -> None:
        page, b, weight = (np.concatenate(c) for c in zip(self.best, *self.waiting, strict=True))
        order = np.lexsort((b, -weight, page))
        page, b, weight = page[order], b[order], weight[order]
        fresh = np.flatnonzero(np.append(True, page[1:] != page[:-1])) if len(page) else np.zeros(0, np.int64)
        place = np.arange(len(page)) - np.repeat(fresh, np.diff(np.append(fresh, len(page))))
        stay = place < self.k
        last = page[place == self.k - 1], weight[place == self.k - 1]
        if self.ready:
            self.least[last[0]] = last[1]
        self.best, self.waiting, self.waits = (page[stay], b[stay], weight[stay]), [], 0
