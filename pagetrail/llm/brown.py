"""Scores of texts by a class-based word model (Brown classes found by exchange).

P(word | word before) = P(class | class before) * P(word | class). Words of at least `LEAST` occurrences in
the training texts, the `MOVABLE` most frequent at most, get one of `CLASSES` classes by exchange: a word
moves to the class where the likelihood of the class bigrams is largest. All other words are in the class of
their frequency (by powers of two); words that occur once share theirs with the unknown word. Each text
ends with a token that is a class by itself, and begins after one.

1. Texts become numbers of their words, a piece of texts at a time; the distinct words of each piece are
   dealt into four buckets a shuffle partition, packed; a bucket counts them over all pieces and answers each
   piece. So no task needs the whole vocabulary, and no row is a word.
2. Pairs of neighbours are summed once for each movable word, from both sides, and stay where they are.
3. A sweep tries half of the words, each in all classes, against the class bigrams before it; tasks get the
   class of each movable word (2 MB at most) and return those that changed. The classes of the best sweep
   stay.
4. Transitions are counted over all training texts, and every text is scored.

Transitions are mixed with the frequency of the class as if that had been seen `PRIOR` times after each
class. In the class of words seen once, the unknown word has the share n1 / (n1 + 2 * n2), what such words
get in other texts by Good and Turing; n1 and n2 count the words seen once and twice. The probabilities of
all words and the unknown one after any word add up to 1.

Defined results: null text counts as empty, which is one token, the end; a null id counts as an empty one
where texts are held out, and stays null; rows that repeat count each; without training texts every word is
unknown; an empty table gives an empty result; a text of any length is in one piece; other columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm.batches import give_back, pieces
from pagetrail.llm.shared import table, written
from pagetrail.llm.varint import packed, unpacked
from pagetrail.llm.words import Words, binary_texts, byte_set

CLASSES, LEAST, MOVABLE, SWEEPS, PRIOR = 64, 30, 1 << 20, 8, 20.0
#: Classes by frequency, one for each power of two, and the class of the end.
RARE = 40
APART = byte_set(b" \t\n\x0b\x0c\r")
FOLDS, HELD = 7, 2
PIECE = "piece long, documents binary, tokens binary, bucket int, codes binary, n binary, words binary"
COUNT = "bucket int, words binary, n binary, total long, distinct long, once long, twice long, word string, often long"
KNOWN = "documents binary, tokens binary, counts binary, slots binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _cut(values: np.ndarray, cuts: np.ndarray):
    """Packed values as an Arrow array of bytes, cut at those places."""
    import pyarrow as pa

    raw, at = packed(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at[cuts].astype(np.int32)), pa.py_buffer(raw)])


def _joined(words, cuts: np.ndarray):
    """Words, a space after each, as an Arrow array of bytes cut at those places."""
    import pyarrow as pa

    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset :][: len(words) + 1]
    place = np.arange(ends[-1] - ends[0]) + np.repeat(np.arange(len(words)), np.diff(ends))
    out = np.full(len(place) + len(words), 32, np.uint8)
    out[place] = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((ends[cuts] - ends[0] + cuts).astype(np.int32)), pa.py_buffer(out)])


def _apart(raw: bytes):
    """The words of such bytes."""
    import pyarrow as pa

    data = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero(data == 32)
    offsets = np.r_[0, gaps - np.arange(len(gaps))].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(gaps), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 32])])


def numbered(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """A row for each piece (documents, tokens) and for each bucket of its distinct words: codes, n (occurrences in training texts), words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        for number, batch in enumerate(pieces(batches, 2)):
            piece = (TaskContext.get().partitionId() << 32) + number
            s = Words(binary_texts(batch.column(2)), APART)
            texts, distinct = batch.num_rows, len(s.distinct)
            by_count = np.argsort(-np.bincount(s.code, minlength=distinct), kind="stable")
            place = np.empty(distinct, np.int64)
            place[by_count] = np.arange(1, distinct + 1)  # the end is 0
            size = np.bincount(s.texts, minlength=texts).astype(np.int64) + 1
            tokens = np.zeros(size.sum(), np.int64)
            tokens[np.arange(len(s.code)) + s.texts] = place[s.code]
            held = np.asarray(batch.column(1)).astype(bool)
            n = np.bincount(tokens[np.repeat(~held, size)], minlength=distinct + 1).astype(np.int64)
            ids = batch.column(0)
            about = ids.fill_null(0).to_numpy().astype("<i8").tobytes() + size.astype("<i8").tobytes() + held.astype(np.uint8).tobytes() + np.asarray(ids.is_null()).astype(np.uint8).tobytes()

            bucket = np.r_[0, (s.hashes()[by_count] % np.uint64(buckets)).astype(np.int64)]
            code = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[code]) > 0, True])
            step = np.diff(code, prepend=0)
            step[cuts[:-1]] = code[cuts[:-1]]
            words = pa.concat_arrays([pa.array([b""], pa.large_binary()), s.distinct.take(pa.array(by_count))]).take(pa.array(code))
            rows, none = len(cuts) - 1, pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows + 1, piece)),
                pa.concat_arrays([pa.array([about], pa.binary()), pa.nulls(rows, pa.binary())]),
                pa.concat_arrays([pa.array([packed(tokens)[0].tobytes()], pa.binary()), pa.nulls(rows, pa.binary())]),
                pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(bucket[code][cuts[:-1]].astype(np.int32))]),
                *(pa.concat_arrays([none, column]) for column in (_cut(step, cuts), _cut(n[code], cuts), _joined(words, cuts))),
            ], _names(PIECE))
        give_back()

    doc_id = F.col(id_col).cast("long")
    held = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD
    return docs.select(doc_id.alias("doc_id"), held.alias("held"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


def counted(rows: DataFrame, least: int) -> DataFrame:
    """A row for each bucket with the counts of its words over all pieces and their sums, and one for each word of `least` or more (word, often)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def summed_up(parts):
            return pa.concat_tables(parts).group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"])

        def done(bucket, parts):
            words = summed_up(parts).combine_chunks()
            n = words.column("n").to_numpy()
            own = np.asarray(pc.not_equal(words.column("w"), pa.scalar(b"", pa.large_binary())))
            w = words.column("w").combine_chunks()
            w = w if isinstance(w, pa.Array) else w.chunk(0)
            many = np.flatnonzero((n >= least) & own)
            often = w.take(pa.array(many))
            rows = len(many)
            sums = (n.sum(), (n > 0).sum(), ((n == 1) & own).sum(), ((n == 2) & own).sum())
            cuts = np.array([0, len(n)])
            text = pa.Array.from_buffers(pa.large_string(), rows, often.buffers(), often.null_count, often.offset).cast(pa.string(), safe=False)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(rows + 1, bucket, np.int32)),
                pa.concat_arrays([_joined(w, cuts), pa.nulls(rows, pa.binary())]),
                pa.concat_arrays([_cut(n, cuts), pa.nulls(rows, pa.binary())]),
                *(pa.concat_arrays([pa.array([int(x)], pa.int64()), pa.nulls(rows, pa.int64())]) for x in sums),
                pa.concat_arrays([pa.nulls(1, pa.string()), text]),
                pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(n[many], pa.int64())]),
            ], _names(COUNT))

        at, parts, loose = None, [], 0
        for batch in batches:
            for bucket, n, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if bucket != at and parts:
                    yield done(at, parts)
                    parts, loose = [], 0
                at = bucket
                parts.append(pa.table({"w": _apart(words.as_py()), "n": pa.array(unpacked(n.as_py()))}))
                loose += parts[-1].num_rows if len(parts) > 1 else 0
                if loose > max(1 << 17, parts[0].num_rows):  # sum up before it grows
                    parts, loose = [summed_up(parts)], 0
        if parts:
            yield done(at, parts)
        give_back()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.filter("bucket IS NOT NULL").select("bucket", "n", "words")
    return some.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, COUNT)


def ranked(words: DataFrame, movable: int) -> DataFrame:
    """(bucket, word, slot): the movable words among those of words(bucket, word, often), numbered by descending count."""
    some = written(words.orderBy(F.desc("often"), "word").select("bucket", "word", F.monotonically_increasing_id().alias("at")), "movable")
    part = F.shiftright("at", 33)
    sizes = sorted(map(tuple, some.groupBy(part.alias("part")).count().collect()))  # a row a partition
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    first = words.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    slot = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return some.withColumn("part", part).join(F.broadcast(first), "part").select("bucket", "word", slot.cast("int").alias("slot")).filter(F.col("slot") < movable)


def answered(rows: DataFrame, counts: DataFrame, slots: DataFrame) -> DataFrame:
    """KNOWN: the pieces with count and slot (from 1, 0 for none) of each of their words."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None)
    columns = ["bucket", "kind", "piece", "codes", "n", "words", "word", "slot"]
    lists = counts.filter("words IS NOT NULL").select("bucket", F.lit(0).alias("kind"), none.cast("long").alias("piece"), none.cast("binary").alias("codes"), "n", "words", none.cast("string").alias("word"), none.cast("int").alias("slot"))
    numbers = slots.select("bucket", F.lit(1).alias("kind"), none.cast("long").alias("piece"), *(none.cast("binary").alias(c) for c in ("codes", "n", "words")), "word", "slot")
    asked = rows.filter("bucket IS NOT NULL").select("bucket", F.lit(2).alias("kind"), "piece", "codes", none.cast("binary").alias("n"), "words", none.cast("string").alias("word"), none.cast("int").alias("slot"))

    def look_up(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known = n_ = slot = None
        for batch in batches:
            bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]), True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if len(kind) else []:
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    known, n_ = _apart(part.column(5)[0].as_py()), unpacked(part.column(4)[0].as_py())
                    slot = np.zeros(len(n_), np.int64)
                elif kind[a] == 1:
                    slot[pc.index_in(part.column(6).cast(pa.binary()).cast(pa.large_binary()), value_set=known).to_numpy()] = part.column(7).to_numpy() + 1
                else:
                    words = [_apart(w.as_py()) for w in part.column(5)]
                    found = pc.index_in(pa.concat_arrays(words), value_set=known).to_numpy()
                    ends = np.cumsum([0, *map(len, words)])
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), _cut(n_[found], ends), _cut(slot[found], ends)], ["piece", "codes", "counts", "slots"])
        give_back()

    dealt = lists.unionByName(numbers).unionByName(asked).select(*columns).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    found = dealt.mapInArrow(look_up, "piece long, codes binary, counts binary, slots binary")
    texts = rows.filter("bucket IS NULL").select("piece", F.lit(0).alias("kind"), "documents", "tokens", *(none.cast("binary").alias(c) for c in ("codes", "counts", "slots")))
    words = found.select("piece", F.lit(1).alias("kind"), none.cast("binary").alias("documents"), none.cast("binary").alias("tokens"), "codes", "counts", "slots")

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def whole(text, parts):
            codes = np.concatenate([p[0] for p in parts])
            values = np.zeros((2, len(codes)), np.int64)
            for k in range(2):
                values[k, codes] = np.concatenate([p[k + 1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*text, *(packed(v)[0].tobytes() for v in values))], _names(KNOWN))

        text, parts = None, []
        for batch in batches:
            for kind, *cells in zip(batch.column(1).to_pylist(), *(batch.column(c) for c in range(2, 7)), strict=True):
                if kind == 0:
                    if parts:
                        yield whole(text, parts)
                    text, parts = [c.as_py() for c in cells[:2]], []
                else:
                    codes, counts_, slots_ = (unpacked(c.as_py()) for c in cells[2:])
                    parts.append((np.cumsum(codes), counts_, slots_))
        if parts:
            yield whole(text, parts)
        give_back()

    return texts.unionByName(words).repartition(n, "piece").sortWithinPartitions("piece", "kind").mapInArrow(put, KNOWN)


class Piece:
    """Texts as places of their words, with count and slot (or -1) of each word."""

    def __init__(self, documents: bytes, tokens: bytes, counts: bytes, slots: bytes):
        texts = len(documents) // 18
        self.ids, self.size = np.frombuffer(documents, "<i8", 2 * texts).reshape(2, texts)
        self.held, self.null = np.frombuffer(documents, np.uint8, 2 * texts, 16 * texts).reshape(2, texts).astype(bool)
        self.tokens = unpacked(tokens)
        self.counts, self.slots = unpacked(counts), unpacked(slots) - 1
        self.starts = np.cumsum(self.size) - self.size

    def nodes(self, movable: int) -> np.ndarray:
        """Of each word its slot; beyond the slots the classes by frequency, and then the end."""
        fixed = np.floor(np.log2(np.maximum(self.counts, 1))).astype(np.int64).clip(0, RARE - 1)
        fixed[0] = RARE
        return np.where(self.slots >= 0, self.slots, movable + fixed)

    def training_pairs(self, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands for each token of the training texts, and for the one before it; the end stands before a text."""
        here = of_word[self.tokens]
        before = np.r_[of_word[0], here[:-1]]
        before[self.starts] = of_word[0]
        trained = np.repeat(~self.held, self.size)
        return before[trained], here[trained]


def read_pieces(batches: Iterator) -> Iterator[Piece]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Piece(*(batch.column(c)[k].as_py() for c in range(4)))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)


def neighbours(known: DataFrame, movable: int, buckets: int) -> DataFrame:
    """(bucket, pairs): ascending keys (word, other, side) as steps, with their counts; a word is in one bucket."""
    nodes = movable + RARE + 1

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for piece in read_pieces(batches):
            before, here = piece.training_pairs(piece.nodes(movable))
            pair, n = np.unique(before * nodes + here, return_counts=True)
            a, b = pair // nodes, pair % nodes
            word, other, side = np.r_[a, b], np.r_[b, a], np.repeat([0, 1], len(pair))
            some = word < movable
            word, key, n = word[some], ((word * nodes + other) * 2 + side)[some], np.r_[n, n][some]
            order = np.lexsort((key, word % buckets))
            word, key, n = word[order], key[order], n[order]
            cuts = np.searchsorted(word % buckets, np.arange(buckets + 1))
            rows = [(j, packed(np.stack([np.diff(key[a:b], prepend=0), n[a:b]], axis=1).ravel())[0].tobytes()) for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "pairs"])
        give_back()

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def row(bucket, parts):
            key, n = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed(np.stack([np.diff(key, prepend=0), n], axis=1).ravel())[0].tobytes()], pa.binary())], ["bucket", "pairs"])

        bucket, parts, loose = None, [], 0
        for batch in batches:
            for j, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if j != bucket and parts:
                    yield row(bucket, parts)
                    parts, loose = [], 0
                bucket = j
                steps = unpacked(raw.as_py()).reshape(-1, 2)
                parts.append((np.cumsum(steps[:, 0]), steps[:, 1]))
                loose += len(steps) if len(parts) > 1 else 0
                if loose > max(1 << 18, len(parts[0][0])):  # sum up before it grows
                    parts, loose = [summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))], 0
        if parts:
            yield row(bucket, parts)
        give_back()

    kind = "bucket int, pairs binary"
    n = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = known.mapInArrow(gather, kind)
    return written(made.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, kind), "neighbours")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(bigrams: np.ndarray) -> float:
    return float(xlogx(bigrams).sum() - xlogx(bigrams.sum(axis=0)).sum() - xlogx(bigrams.sum(axis=1)).sum())


def bigram_rows(total: np.ndarray):
    import pyarrow as pa

    a, b = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["a", "b", "n"])


def matrix(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of (a, b, n) as a matrix; classes are few."""
    got = rows.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, size), np.int64)
    out[got.column("a").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out


def best_classes(word: np.ndarray, other: np.ndarray, n: np.ndarray, own: np.ndarray, bigrams: np.ndarray, classes: int) -> np.ndarray:
    """The class of largest likelihood for each of own's words, with all others where they are.

    Entries (word, other, n) ascend by word, an index into own; other: the class of the neighbour after
    it, or that of the one before it plus the number of all classes.
    """
    size = len(bigrams)
    n = n.astype(np.float64)
    around = np.concatenate([bigrams[:classes], bigrams[:, :classes].T], axis=1).astype(np.float64).T  # (neighbour, class)
    sides = np.stack([bigrams.sum(axis=1), bigrams.sum(axis=0)]).astype(np.float64)[:, :classes]
    gain = np.zeros((len(own), classes))
    plain, step = xlogx(around), max(1, (1 << 20) // classes)
    cuts = [0]
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    while cuts[-1] < len(word):
        after = np.searchsorted(starts, cuts[-1] + step)
        cuts.append(int(starts[after]) if after < len(starts) else len(word))
    mine = own[word]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w, j, m = word[a:b], other[a:b], n[a:b]
        add = xlogx(around[j] + m[:, None]) - plain[j]
        k = np.arange(b - a)
        add[k, mine[a:b]] = plain[j, mine[a:b]] - xlogx(around[j, mine[a:b]] - m)  # at home it is counted already
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        gain[w[first]] += np.add.reduceat(add, first)
    for side in range(2):
        total = np.bincount(word, n * ((other >= size) == bool(side)), len(own))
        more = xlogx(sides[side] + total[:, None]) - xlogx(sides[side])
        k = np.arange(len(own))
        more[k, own] = xlogx(sides[side][own]) - xlogx(sides[side][own] - total)
        gain -= more
    best = gain.argmax(axis=1)
    return np.where(gain[np.arange(len(own)), best] > gain[np.arange(len(own)), own] + 1e-6, best, own)


def exchange(around: DataFrame, movable: int, classes: int, sweeps: int) -> np.ndarray:
    """The class of every slot."""
    context = around.sparkSession.sparkContext
    nodes, size = movable + RARE + 1, classes + RARE + 1
    fixed = np.arange(classes, size)
    now = np.arange(movable) % classes
    best, best_at = now, -np.inf

    def entries(raw: bytes):
        steps = unpacked(raw).reshape(-1, 2)
        key = np.cumsum(steps[:, 0])
        return key // (2 * nodes), key // 2 % nodes, key % 2, steps[:, 1]

    for sweep in range(sweeps + 1):
        shared = context.broadcast(now.astype(np.int16))

        def count(batches: Iterator, shared=shared) -> Iterator:
            of, total = np.r_[shared.value, fixed].astype(np.int64), np.zeros(size * size, np.int64)
            for batch in batches:
                for raw in batch.column(1):
                    word, other, side, n = entries(raw.as_py())
                    use = (side == 0) | (other >= movable)  # pairs of two movable words once
                    key = np.where(side == 0, of[word] * size + of[other], of[other] * size + of[word])
                    total += np.bincount(key[use], n[use], size * size).astype(np.int64)
            yield bigram_rows(total.reshape(size, size))

        bigrams = matrix(around.mapInArrow(count, "a int, b int, n long"), size)
        at = likelihood(bigrams)
        if at > best_at:
            best, best_at = now, at
        if sweep == sweeps:
            break

        def move(batches: Iterator, shared=shared, bigrams=bigrams, sweep=sweep) -> Iterator:
            import pyarrow as pa

            of = np.r_[shared.value, fixed].astype(np.int64)
            for batch in batches:
                for raw in batch.column(1):
                    word, other, side, n = entries(raw.as_py())
                    turn = (word * 0x9E3779B1 >> 7) % 2 == sweep % 2
                    word, other, n = word[turn], (of[other] + size * side)[turn], n[turn]
                    key, n = summed(word * (2 * size) + other, n)
                    slot, index = np.unique(key // (2 * size), return_inverse=True)
                    if len(slot):
                        new = best_classes(index, key % (2 * size), n, of[slot], bigrams, classes)
                        some = new != of[slot]
                        yield pa.RecordBatch.from_arrays([pa.array(slot[some].astype(np.int32)), pa.array(new[some].astype(np.int32))], ["slot", "class"])
            give_back()

        moved = around.mapInArrow(move, "slot int, class int").toArrow()  # a row a movable word at most
        shared.unpersist()
        if not moved.num_rows and sweep % 2:
            break
        now = now.copy()
        now[moved.column("slot").to_numpy()] = moved.column("class").to_numpy()
    return best


@dataclass
class ClassModel:
    """Probabilities of words after words; classes beyond `classes` are those by frequency and that of the end."""

    of_slot: np.ndarray
    bigrams: np.ndarray
    classes: int
    once: int
    twice: int
    prior: float = PRIOR

    def __post_init__(self):
        total = self.bigrams.sum(axis=0) + 0.5
        self.share = total / total.sum()
        seen = self.bigrams.sum(axis=1, keepdims=True)
        self.after = np.log10((self.bigrams + self.prior * self.share) / (seen + self.prior))
        self.unknown = self.once / (self.once + 2 * self.twice) if self.once else 1.0
        self.size = np.log10(np.maximum(self.bigrams.sum(axis=0), 1))

    def class_of(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        fixed = self.classes + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64).clip(0, RARE - 1)
        fixed[0] = self.classes + RARE
        return np.where(slots >= 0, self.of_slot[np.maximum(slots, 0)] if len(self.of_slot) else 0, fixed)

    def within(self, of: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of P(word | class)."""
        share = np.log10(np.maximum(counts, 1)) - self.size[of]
        if self.once and self.unknown < 1:
            share = np.where(counts == 1, share + np.log10(1 - self.unknown), share)
        elif self.once:
            share = np.where(counts == 1, -np.inf, share)
        return np.where(counts == 0, np.log10(self.unknown), share)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, least: int = LEAST, movable: int = MOVABLE, sweeps: int = SWEEPS, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: a row per document."""
    context = docs.sparkSession.sparkContext
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(numbered(docs, id_col, text_col, buckets), "pieces")
    counts = written(counted(rows, least), "counts")
    total, distinct, once, twice = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "once", "twice"))).first()
    slots = written(ranked(counts.filter("word IS NOT NULL").select("bucket", "word", "often"), movable), "slots")
    n_slots = slots.count()
    known = written(answered(rows, counts, slots), "known")

    of_slot = np.zeros(0, np.int64)
    if n_slots:
        of_slot = exchange(neighbours(known, n_slots, buckets), n_slots, classes, sweeps)
    size = classes + RARE + 1
    shape = ClassModel(of_slot.astype(np.int16), np.zeros((size, size), np.int64), classes, once, twice, prior)
    first = context.broadcast(shape)

    def count(batches: Iterator) -> Iterator:
        sums = np.zeros(size * size, np.int64)
        for piece in read_pieces(batches):
            before, now = piece.training_pairs(first.value.class_of(piece.slots, piece.counts))
            sums += np.bincount(before * size + now, minlength=size * size)
        yield bigram_rows(sums.reshape(size, size))

    bigrams = matrix(known.mapInArrow(count, "a int, b int, n long"), size)
    model = context.broadcast(ClassModel(shape.of_slot, bigrams, classes, once, twice, prior))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = model.value
        for piece in read_pieces(batches):
            if not len(piece.size):
                continue
            of = m.class_of(piece.slots, piece.counts)
            now = of[piece.tokens]
            before = np.r_[of[0], now[:-1]]
            before[piece.starts] = of[0]
            each = m.after[before, now] + m.within(of, piece.counts)[piece.tokens]
            base = np.log10((piece.counts + 1) / (total + 1 * (distinct + 1)))[piece.tokens]
            met = (piece.counts > 0)[piece.tokens]
            columns = [pa.array(piece.ids.astype(np.int64), mask=piece.null), pa.array(piece.held), pa.array(piece.size.astype(np.int64)), *(pa.array(np.add.reduceat(x, piece.starts)) for x in (met.astype(np.int64), base, each))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])
        give_back()

    out = known.mapInArrow(score, RESULT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op13_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op13_brown_classes": op13_brown_classes}
ORACLES: dict[str, str] = {}
