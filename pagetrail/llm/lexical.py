"""Ranked lexical search over compressed postings: Block-Max MaxScore.

The index holds all terms of all documents, in shards of about `SHARD_BYTES` of text. Inside a shard
documents are numbered by ascending id, and the postings of a term are blocks of `BLOCK` documents, each
with the largest frequency and the least length in it; a score never falls with the frequency or rises
with the length, so these two bound what the block can add, whatever the size of the corpus.

A search joins the terms of its items with the index, so that only postings of asked terms move, and deals
them by shard and group of `ITEMS` items. There an item's lists are ordered by what they can add anywhere.
The first lists whose bounds together stay below the score of the k-th hit so far are not essential: a
document in none of the others cannot be a hit. Candidates come from the essential lists; on the others,
from the largest bound down, a candidate is given up where the bound of its block, with those of the lists
left, is too low, and only blocks that still have candidates are decompressed. The hits of each shard are
merged by rank; a task keeps no more than k of an item.

Defined results: null text has no terms; rows that share a document id are documents of their own, a null
id is smaller than any other; rows that share an item id are one item with the terms of all of them;
equal scores go by document id; items without terms, or terms that occur nowhere, give no hits; a text of
any length is in one shard; empty tables give an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.llm.batches import PIECE_BYTES, give_back, pieces
from pagetrail.llm.shared import table, written
from pagetrail.llm.varint import packed, unpacked
from pagetrail.llm.words import Words, binary_texts, byte_set

TOP, BLOCK, ITEMS, SHARD_BYTES = 50, 128, 256, PIECE_BYTES
#: Documents of a shard that are scored between two looks at the k-th hit.
STRIDE = 1024
GAPS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
APART = byte_set(GAPS)
INDEX = "shard long, term string, block int, n long, words long, most int, least int, first int, last int, payload binary"


def terms(text: Column) -> Column:
    """The distinct terms of a text: letters and digits of ASCII, lowered, and all characters beyond it."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(low, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != ""))


def shard_rows(ids, texts: list[bytes], shard: int):
    """The index rows of a shard: one of its documents (term null), then blocks of postings, ordered by term."""
    import pyarrow as pa
    import pyarrow.compute as pc

    s = Words(texts, APART)
    by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)
    number = np.empty(len(texts), np.int64)
    number[by_id] = np.arange(len(texts))
    doc_of = number[s.texts]
    lengths = np.bincount(doc_of, minlength=len(texts)).astype(np.int64)
    sorted_ids = ids.take(pa.array(by_id))
    documents = sorted_ids.fill_null(0).to_numpy().astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + np.asarray(sorted_ids.is_null()).astype(np.uint8).tobytes()
    order = pc.sort_indices(s.distinct).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    both, tf = np.unique(rank[s.code] * len(texts) + doc_of, return_counts=True)
    term, doc = both // max(1, len(texts)), both % max(1, len(texts))
    begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    df = np.diff(np.r_[begins, len(term)])
    count = -(-df // BLOCK)
    block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(begins, count) + BLOCK * block
    ends = np.r_[at[1:], len(term)]
    step = np.r_[doc[:1], np.diff(doc)] if len(doc) else doc
    step[at] = doc[at]
    raw, places = packed(np.stack([step, tf], axis=1).ravel())
    offsets = np.r_[places[2 * at], places[-1]].astype(np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    blocks = len(at)
    columns = [
        pa.array(np.full(blocks + 1, shard)),
        pa.concat_arrays([pa.nulls(1, pa.string()), s.strings(order[term[at]])]),
        pa.array(np.r_[-1, block].astype(np.int32)),
        pa.array(np.r_[(lengths > 0).sum(), ends - at].astype(np.int64)),
        pa.array(np.r_[lengths.sum(), np.zeros(blocks)].astype(np.int64)),
        *(pa.array(np.r_[0, x].astype(np.int32)) for x in ((np.maximum.reduceat(tf, at), np.minimum.reduceat(lengths[doc], at), doc[at], doc[ends - 1]) if blocks else [np.zeros(0)] * 4)),
        pa.concat_arrays([pa.array([documents], pa.binary()), payload]),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs, written."""

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        for number, batch in enumerate(pieces(batches, 1, shard_bytes)):
            yield shard_rows(batch.column(0), binary_texts(batch.column(1)), (TaskContext.get().partitionId() << 32) + number)

    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX), "index")


class Shard:
    """Postings of asked terms in one shard, and the documents there."""

    def __init__(self, documents: bytes, n_docs: int, n_terms: int):
        size = len(documents) // 13
        self.ids = np.frombuffer(documents, "<i8", size)
        lengths = np.frombuffer(documents, "<u4", size, 8 * size).astype(np.int64)
        self.null = np.frombuffer(documents, np.uint8, size, 12 * size).astype(bool)
        self.n_docs, self.n_terms = n_docs, n_terms
        self.norm = self.norm_of(lengths)
        self.lists: list[dict] = []
        self.items: dict = {}
        self.opened = self.blocks = 0

    def norm_of(self, length: np.ndarray) -> np.ndarray:
        return 50 + 50 * length * self.n_docs // max(1, self.n_terms)

    @staticmethod
    def share(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 20 * norm)

    def add(self, weight: int, bound: int, items: list, blocks: list[tuple]) -> None:
        """A term's list; blocks: (most, least, first, last, payload) in order."""
        most, least, first, last = (np.array(c, np.int64) for c in list(zip(*blocks, strict=True))[:4])
        bounds = weight * self.share(most, self.norm_of(least))
        self.lists.append({"weight": weight, "bound": bound, "bounds": bounds, "first": first, "last": last, "raw": [b[4] for b in blocks], "open": {}})
        self.blocks += len(blocks)
        for item in items:
            self.items.setdefault(item, []).append(len(self.lists) - 1)

    def block(self, term: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, what the term adds to each) of a block, decompressed once."""
        if k not in term["open"]:
            pairs = unpacked(term["raw"][k]).reshape(-1, 2)
            docs = np.cumsum(pairs[:, 0])
            term["open"][k] = docs, term["weight"] * self.share(pairs[:, 1], self.norm[docs])
            self.opened += 1
        return term["open"][k]

    def hits(self, item, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best k, all above 0; of equal scores the lower number."""
        lists = sorted((self.lists[i] for i in self.items[item]), key=lambda t: t["bound"])
        reach = np.cumsum([t["bound"] for t in lists])
        best_doc, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for low in range(0, len(self.ids), STRIDE):
            need = int(best[-1]) + 1 if len(best) == k else 1
            spare = int(np.searchsorted(reach, need))  # lists that cannot reach it together
            if spare == len(lists):
                break
            got = np.zeros(min(STRIDE, len(self.ids) - low), np.int64)
            for t in lists[spare:]:
                for i in range(int(np.searchsorted(t["last"], low)), int(np.searchsorted(t["first"], low + len(got)))):
                    docs, adds = self.block(t, i)
                    if docs[0] < low or docs[-1] >= low + len(got):
                        a, b = np.searchsorted(docs, (low, low + len(got)))
                        docs, adds = docs[a:b], adds[a:b]
                    got[docs - low] += adds
            left = np.flatnonzero(got)
            for i in range(spare - 1, -1, -1):
                left = left[got[left] + reach[i] >= need]
                if not len(left):
                    break
                t, below = lists[i], reach[i - 1] if i else 0
                at = np.minimum(np.searchsorted(t["last"], left + low), len(t["last"]) - 1)
                inside = (t["first"][at] <= left + low) & (left + low <= t["last"][at])
                stays = got[left] + np.where(inside, t["bounds"][at], 0) + below >= need
                left, at, inside = left[stays], at[stays], inside[stays]
                for k_ in np.unique(at[inside]).tolist():
                    docs, adds = self.block(t, k_)
                    some = left[inside & (at == k_)]
                    p = np.minimum(np.searchsorted(docs, some + low), len(docs) - 1)
                    met = docs[p] == some + low
                    got[some[met]] += adds[p[met]]
            left = left[got[left] >= need]
            if len(left):
                doc, score = np.r_[best_doc, left + low], np.r_[best, got[left]]
                order = np.lexsort((doc, -score))[:k]
                best_doc, best = doc[order], score[order]
        return best_doc, best


HIT = "item_id long, doc_id long, score long"


def search(index: DataFrame, items: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text", group: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = index.sparkSession
    n_docs, n_terms = index.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.explode(terms(F.col(text_col))).alias("term")).distinct()
    asked = written(asked, "asked")
    groups = max(1, -(-asked.select("item").distinct().count() // group))
    wanted = index.filter("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi")
    wanted = written(wanted, "wanted")

    norm = F.lit(50).cast("long") + F.expr(f"(50 * CAST(least AS BIGINT) * {n_docs}L) div {max(1, n_terms)}L")
    share = F.expr("(1000000000 * CAST(most AS BIGINT)) div (1000 * CAST(most AS BIGINT) + 20 * norm)")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    known = wanted.withColumn("norm", norm).groupBy("term").agg(F.sum("n").alias("df"), F.max(share).alias("share"))
    known = known.select("term", weight.cast("long").alias("weight"), (weight.cast("long") * F.col("share")).alias("bound"))
    by_group = asked.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("dealt")).agg(F.collect_list(F.struct("item")).alias("items"))  # a list itself would lose nulls
    lists = written(by_group.join(known, "term"), "lists")

    columns = ["shard", "dealt", "term", "block", "most", "least", "first", "last", "payload", "weight", "bound", "items"]
    dealt = wanted.join(lists, "term").withColumn("items", F.when(F.col("block") == 0, F.col("items"))).select(*columns)
    here = wanted.select("shard", "term").distinct().join(lists.select("term", "dealt"), "term").select("shard", "dealt").distinct()
    documents = index.filter("term IS NULL").join(here, "shard").withColumns({"weight": F.lit(0).cast("long"), "bound": F.lit(0).cast("long"), "items": F.lit(None).cast("array<struct<item:long>>")}).select(*columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def solved(shard: Shard):
            out = []
            for item in shard.items:
                docs, scores = shard.hits(item, k)
                out.append((np.full(len(docs), 0 if item is None else item), np.full(len(docs), item is None), shard.ids[docs], shard.null[docs], scores))
            item, no_item, doc, no_doc, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
            return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64), mask=no_item.astype(bool)), pa.array(doc.astype(np.int64), mask=no_doc.astype(bool)), pa.array(score.astype(np.int64))], ["item_id", "doc_id", "score"])

        key = shard = term = None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(len(columns))), strict=True)
            for shard_id, group_, word, block, most, least, first, last, payload, w, bound, items_ in rows:
                if (shard_id, group_) != key or word != (term and term[0]):
                    if term:
                        shard.add(*term[1:])
                        term = None
                if (shard_id, group_) != key:
                    if shard:
                        yield solved(shard)
                    key, shard = (shard_id, group_), Shard(payload, n_docs, n_terms)
                    continue
                if not term:
                    term = (word, w, bound, [x["item"] for x in items_], [])
                term[4].append((most, least, first, last, payload))
        if term:
            shard.add(*term[1:])
        if shard:
            yield solved(shard)
        give_back()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = dealt.unionByName(documents).repartition(n, "shard", "dealt").sortWithinPartitions("shard", "dealt", F.col("block") >= 0, "term", "block")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return tasks.mapInArrow(run, HIT).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_block_max_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n),
r AS (SELECT item_id, doc_id, k, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n) // l)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (k), s GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM t WHERE rank <= 50
"""
QUERIES = {"op12_block_max_maxscore": op12_block_max_maxscore}
ORACLES = {"op12_block_max_maxscore": SQL}
