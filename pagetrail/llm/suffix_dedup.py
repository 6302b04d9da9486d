"""Removal of long repeated passages by prefix-free parsing.

A byte place whose next `TRIGGER` bytes have a rolling hash of zero (modulo about a sixth of the
length, a power of two) begins a phrase.
The rule looks at those bytes alone, so equal strings are cut alike, and no phrase (taken with the
trigger that follows it) is a prefix of another. A window of `length` bytes is known by its first
phrase start: what lies before it is a suffix of a dictionary phrase, what follows is a piece of the
parse. Corpus order of all windows is so the order of dictionary suffixes combined with the order of
parse suffixes, and is built where it can matter only:

1. every phrase start names its neighbourhood, from the phrase start before to `length` bytes on, by
   a rolling hash of its first `anchor` bytes and a digest of the whole (BLAKE2b, 128 bits);
   neighbourhoods meet by the first. One that occurs twice as a whole is repeated, one whose first hash
   occurs once is not, and nothing else is left but the borders of repeated passages;
2. borders that share their first bytes meet in one task, which ranks their phrases (the dictionary),
   sorts their parses by those ranks (suffix array of the parse, with common prefixes) and their left
   parts from the right (suffix array of the dictionary, with common suffixes), and reads from both
   which windows occur twice, byte by byte;
3. windows far from any phrase start (periodic text) go by the digest of the whole window.

The rolling hashes only choose what is compared: where they collide, more is compared. What is removed
has been found equal by its bytes or by its digest.

Where more than `HOT` different borders share their first bytes, their windows are counted by digest,
with partial sums before the shuffle, in place of step 2; the outcome is the same.

Defined results: null counts as empty; texts shorter than `length` bytes lose nothing; a text of any
length is parsed and cut in one task, and its neighbourhoods are dealt like those of others; matches never
cross documents; rows that repeat id and text are two occurrences of the same text, and both lose it;
an empty table gives an empty result; `suffix_dedup` carries other columns along and keeps whole
UTF-8 characters: one that is covered in part stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm.batches import give_back, pieces
from pagetrail.llm.bloom import joined_few
from pagetrail.llm.hashing import prefix_sums, range_hashes
from pagetrail.llm.shared import table, written

LENGTH, TRIGGER, HOT = 400, 16, 20_000
_TRIGGER_BYTES = np.random.default_rng(3).integers(0, 1 << 32, 256, np.uint32)
_FAR = np.uint64(0xA5A5A5A5A5A5A5A5)


def modulus_bits(length: int) -> int:
    """So many that a window without a phrase start among its first four fifths is rare: 64 for 400 bytes."""
    return max(1, int(np.log2(max(2.0, length / 6.25))))


def phrase_starts(data: np.ndarray, bits: int) -> np.ndarray:
    h, span, base = _TRIGGER_BYTES[data], 1, 0x9E3779B1
    while span < TRIGGER:
        h = h[:-span] * np.uint32(base) + h[span:]
        span, base = 2 * span, base * base & 0xFFFFFFFF
    return np.flatnonzero((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits) == 0)


def anchor_bytes(length: int) -> int:
    return max(TRIGGER, length // 5)


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each range of bytes, as a row of two numbers."""
    view, made = memoryview(raw), hashlib.blake2b
    return np.frombuffer(b"".join([made(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def neighbourhoods(raw: bytes, length: int):
    """(first hash, digest of the whole in two parts, place, bytes before, bytes after) of all neighbourhoods of at least `length` bytes of a text."""
    data = np.frombuffer(raw, np.uint8)
    n, anchor = len(data), anchor_bytes(length)
    far = length - anchor
    starts, sums = phrase_starts(data, modulus_bits(length)), prefix_sums(data)
    previous = np.r_[-1, starts[:-1]] if len(starts) else starts
    before, after = np.minimum(starts - previous - 1, far), np.minimum(length, n - starts)
    use = (after >= anchor) & (before + after >= length)
    place, before, after = starts[use], before[use], after[use]
    first = range_hashes(sums, place, place + anchor)
    whole = digests(raw, place - before, place + after) ^ np.stack([before.astype(np.uint64), np.zeros(len(before), np.uint64)], axis=1)
    # window starts with no phrase start among their first bytes
    low, high = np.r_[0, starts + 1], np.minimum(np.r_[starts - far - 1, n - length], n - length)
    size = np.maximum(high - low + 1, 0)
    if size.any():
        p = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        first = np.r_[first, range_hashes(sums, p, p + length) ^ _FAR]
        whole = np.concatenate([whole, digests(raw, p, p + length)])
        place, before, after = np.r_[place, p], np.r_[before, np.zeros(len(p), np.int64)], np.r_[after, np.full(len(p), length)]
    return first, whole[:, 0], whole[:, 1], place, before, after


def union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of a document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    lift = (np.cumsum(np.r_[0, doc[1:] != doc[:-1]])) * (int(end.max()) + 2)  # documents apart on one line
    reach = np.maximum.accumulate(end + lift)
    new = np.r_[True, (start + lift)[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
    return doc[new], start[new], (reach - lift)[last]


def repeated_windows(lefts: list[bytes], rights: list[bytes], length: int) -> list[np.ndarray]:
    """Of each border: the numbers of left bytes, ascending, with which its window occurs in another border too."""
    n = len(lefts)
    # dictionary: ranks of the distinct phrases of all right parts, each with the trigger after it
    parses = []
    for right in rights:
        cuts = phrase_starts(np.frombuffer(right, np.uint8), modulus_bits(length)).tolist() if len(right) >= TRIGGER else []
        cuts = [0, *(c for c in cuts if c)]
        parses.append([right[a : b + TRIGGER] for a, b in zip(cuts, [*cuts[1:], len(right)], strict=True)])
    rank = {phrase: k for k, phrase in enumerate(sorted({p for parse in parses for p in parse}), 1)}
    depth = max(map(len, parses))
    ranks = np.zeros((n, depth), np.int64)
    for i, parse in enumerate(parses):
        ranks[i, : len(parse)] = [rank[p] for p in parse]
    # suffix array of the parse, with common prefixes in bytes
    by_right = np.lexsort(ranks.T[::-1])
    prefix = common([rights[i] for i in by_right])
    # suffix array of the dictionary's left phrases, from the right, with common suffixes in bytes
    turned = [left[::-1] for left in lefts]
    by_left = np.array(sorted(range(n), key=turned.__getitem__), np.int64)
    suffix = common([turned[i] for i in by_left])
    size = np.array([len(x) for x in lefts])
    right_size = np.array([len(x) for x in rights])
    near = np.zeros(n, np.int64)
    near[by_left] = np.maximum(suffix, np.r_[suffix[1:], 0])  # bytes shared with the nearest left part
    found: list[list[int]] = [[] for _ in range(n)]
    right_at, left_at = np.empty(n, np.int64), np.empty(n, np.int64)
    right_at[by_right], left_at[by_left] = np.arange(n), np.arange(n)
    for left in range(int(min(near.max(), size.max())) + 1):
        active = np.flatnonzero((near >= left) & (size >= left) & (right_size >= length - left))
        if len(active) < 2:
            continue
        same_left, same_right = np.cumsum(suffix < left), np.cumsum(prefix < length - left)
        key = same_left[left_at[active]] * (n + 1) + same_right[right_at[active]]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        for i in active[count[inverse] > 1].tolist():
            found[i].append(left)
    return [np.array(f, np.int64) for f in found]


def common(strings: list[bytes]) -> np.ndarray:
    """Bytes that each string shares with the one before it."""
    sizes = np.array([len(s) for s in strings])
    widest = int(sizes.max())
    rows = np.frombuffer(b"".join(s.ljust(widest, b"\0") for s in strings), np.uint8).reshape(len(strings), widest) if widest else np.zeros((len(strings), 0), np.uint8)
    out = np.zeros(len(strings), np.int64)
    for k in range(1, len(strings), 4096):
        a, b = rows[k - 1 : k + 4095][: len(rows[k : k + 4096])], rows[k : k + 4096]
        differ = a != b
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), widest) if widest else np.zeros(len(b), np.int64)
        out[k : k + 4096] = np.minimum(first, np.minimum(sizes[k - 1 : k - 1 + len(b)], sizes[k : k + 4096]))
    return out


#: kind 0: decided, bytes place to place + after; 1: a neighbourhood that a batch saw `times` (1, 2 or more);
#: 2: a border: a whole seen `times`, whose first bytes begin other wholes too.
ROW = "kind int, first long, whole long, check long, doc_id long, text_hash long, place int, before int, after int, times int"


def _rows(kind, first, whole, check, doc_id, text_hash, place, before, after, times):
    import pyarrow as pa

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    columns = [c if isinstance(c, np.ndarray) else np.full(len(doc_id), c) for c in (kind, first, whole, check, doc_id, text_hash, place, before, after, times)]
    columns = [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in ROW.split(", ")])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text_hash (the two name a text), text, absent: the id is null."""
    doc_id, text = key_columns(id_col, text_col)
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), F.col(id_col).isNull().alias("absent"))


def key_columns(id_col: str, text_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def parse(batches: Iterator, length: int) -> Iterator:
    """Neighbourhoods of the texts of a piece, each once; those seen twice are decided at once."""
    for batch in pieces(batches, 2):
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = [neighbourhoods(t.encode("utf-8", "replace"), length) for t in batch.column(2).to_pylist()]
        if not found:
            continue
        doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        first, whole, check, place, before, after = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((check, whole))
        new = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (check[order][1:] != check[order][:-1])][: len(order)]
        at, group = order[new], np.cumsum(new) - 1
        count = np.bincount(group, minlength=len(at))
        some = order[count[group] > 1]
        d, start, end = union(doc[some], (place - before)[some], (place + after)[some])
        yield _rows(0, hashes[d], 0, 0, ids[d], hashes[d], start, 0, end - start, 0)
        yield _rows(1, first[at], whole[at], check[at], ids[doc[at]], hashes[doc[at]], place[at], before[at], after[at], np.minimum(count, 2))


def meet(batches: Iterator) -> Iterator:
    """Decides wholes, leaves borders; rows come sorted by `first` and digest, and one `first` may fill any number of batches.

    A whole at the end of a batch waits for the next one, with what it must know of the rows before it.
    """
    import pyarrow as pa

    held, before_ = None, None  # rows of the last whole, the `first` of the whole before it
    for batch in batches:
        kind = batch.column(0).to_numpy()
        if (done := np.flatnonzero(kind != 1)).size:
            yield batch.take(pa.array(done))
        if (rest := np.flatnonzero(kind == 1)).size:
            rows = [batch.column(c).to_numpy()[rest] for c in range(1, 10)]
            rows = [np.r_[h, r] for h, r in zip(held, rows, strict=True)] if held else rows
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            keep = int(last[-1]) + 1 if len(last) else 0
            if not keep:
                # many rows of one whole: all but two are decided, as there are two at least
                if len(rows[0]) > 2:
                    yield _settled([r[2:] for r in rows])
                    rows = [r[:2] for r in rows]
                held = rows
                continue
            yield from _decided([r[:keep] for r in rows], before_, rows[0][keep])
            before_, held = rows[0][keep - 1], [r[keep:] for r in rows]
    if held:
        yield from _decided(held, before_, None)


def _settled(rows: list[np.ndarray]):
    """Those that occur again elsewhere; a batch of texts has decided its own repeats."""
    _, _, _, doc_id, text_hash, place, before, after, _ = (r[rows[8] == 1] for r in rows)
    return _rows(0, text_hash, 0, 0, doc_id, text_hash, place - before, 0, before + after, 0)


def _decided(rows: list[np.ndarray], earlier, later) -> Iterator:
    """Rows of whole wholes in order; earlier and later: the `first` of the wholes around them."""
    first, whole, check, doc_id, text_hash, place, before, after, times = rows
    new = np.r_[True, (first[1:] != first[:-1]) | (whole[1:] != whole[:-1]) | (check[1:] != check[:-1])]
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    total = np.add.reduceat(times.astype(np.int64), at)
    yield _settled([r[total[of] > 1] for r in rows])
    f = first[at]
    other = np.r_[f[1:] == f[:-1], later is not None and f[-1] == later]
    other |= np.r_[earlier is not None and f[0] == earlier, f[1:] == f[:-1]]
    # wholes that all occur twice need no look at their borders; those at the ends may have others beyond
    group = np.cumsum(np.r_[True, f[1:] != f[:-1]]) - 1
    lone = np.bincount(group, total == 1) > 0
    lone[0] |= earlier is not None and f[0] == earlier
    lone[-1] |= later is not None and f[-1] == later
    other &= lone[group]
    b = at[other]
    yield _rows(2, first[b], whole[b], check[b], doc_id[b], text_hash[b], place[b], before[b], after[b], np.minimum(total[other], 2))


BORDER = "first long, doc_id long, text_hash long, place int, lone boolean, left binary, right binary"


def borders(batches: Iterator) -> Iterator:
    """The bytes of each border of a text."""
    import pyarrow as pa

    for batch in pieces(batches, 2):
        out = []
        for doc_id, text_hash, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode("utf-8", "replace")
            for b in asked:
                p = b["place"]
                out.append((b["first"], doc_id, text_hash, p, b["times"] == 1, raw[p - b["before"] : p], raw[p : p + b["after"]]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        columns = zip(*out, strict=True) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in BORDER.split(", ")])


INTERVAL = "doc_id long, text_hash long, start int, end int"


def _intervals(rows: list[tuple]):
    import pyarrow as pa

    columns = zip(*rows, strict=True) if rows else [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text_hash", "start", "end"])


def ordered(batches: Iterator, length: int, most: int = 4000) -> Iterator:
    """Intervals of the lone borders whose windows occur twice; rows come sorted by `first`."""

    def solve(group: list[tuple]):
        out = []
        found = zip(group, repeated_windows([r[5] for r in group], [r[6] for r in group], length), strict=True)
        for (_, doc_id, text_hash, place, lone, _, _), lefts in found:
            if lone and len(lefts):
                gaps = np.flatnonzero(np.diff(lefts) > length)  # windows that touch are one interval
                for a, b in zip(np.r_[0, gaps + 1], np.r_[gaps, len(lefts) - 1], strict=True):
                    out.append((doc_id, text_hash, place - int(lefts[b]), place - int(lefts[a]) + length))
        return _intervals(out)

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(group) >= most and row[0] != group[-1][0]:
                yield solve(group)
                group = []
            group.append(row)
    if group:
        yield solve(group)
    give_back()


WINDOW = "whole long, check long, doc_id long, text_hash long, start int, lone boolean"


def window_digests(batches: Iterator, length: int) -> Iterator:
    """Every window around hot borders by its digest."""
    import pyarrow as pa

    for batch in batches:
        for _, doc_id, text_hash, place, lone, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shift = np.arange(max(0, length - len(right)), min(len(left), length) + 1)
            if len(shift):
                start, n = len(left) - shift, len(shift)
                whole = digests(left + right, start, start + length).view(np.int64)
                columns = [whole[:, 0].copy(), whole[:, 1].copy(), np.full(n, doc_id), np.full(n, text_hash), (place - shift).astype(np.int32), np.full(n, lone)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in WINDOW.split(", ")])


def repeats(rows: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, start, end): what windows that occur twice cover in rows from keyed(); intervals may overlap."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select("doc_id", "text_hash", "text").filter(F.octet_length("text") >= length)
    parsed = texts.mapInArrow(lambda batches: parse(batches, length), ROW)
    met = written(parsed.repartition(n, "first").sortWithinPartitions("first", "whole", "check").mapInArrow(meet, ROW), "phrases")
    decided = met.filter("kind <> 2").select("doc_id", "text_hash", F.col("place").alias("start"), (F.col("place") + F.col("after")).alias("end"))

    asked = met.filter("kind = 2").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "place", "before", "after", "times")).alias("asked"))
    asked = written(asked, "asked")
    found = written(joined_few(texts, asked, ["doc_id", "text_hash"], "inner").select("doc_id", "text_hash", "text", "asked").mapInArrow(borders, BORDER), "borders")
    many = written(found.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("first"), "many")
    any_ = many.limit(1).count() > 0
    cold = (found.join(many, "first", "left_anti") if any_ else found).repartition(n, "first").sortWithinPartitions("first")
    by_order = cold.mapInArrow(lambda batches: ordered(batches, length), INTERVAL)
    out = decided.unionByName(by_order)
    if any_:
        windows = written(found.join(many, "first", "left_semi").mapInArrow(lambda batches: window_digests(batches, length), WINDOW), "windows")
        twice = windows.groupBy("whole", "check").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("whole", "check")
        out = out.unionByName(windows.filter("lone").join(twice, ["whole", "check"]).select("doc_id", "text_hash", "start", (F.col("start") + length).alias("end")))
    return written(out, "repeats")


def gathered(intervals: DataFrame) -> DataFrame:
    return written(intervals.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def runs(spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (starts, ends) of a text's intervals."""
    pairs = [(s["start"], s["end"]) for s in spans] if spans is not None else []
    start, end = np.array(pairs, np.int64).reshape(-1, 2).T
    return union(np.zeros(len(start), np.int64), start, end)[1:]


def removals(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text: a row per document, removal byte by byte.

    n_bytes is the length of the whole text; text is what is left of it, bytes of a character that is cut in part as U+FFFD.
    """
    rows = keyed(docs, id_col, text_col)
    spans = gathered(repeats(rows, length, **how))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, 2):
            out = []
            for doc_id, absent, text, spans_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "replace")
                starts, ends = runs(spans_)
                kept = b"".join(raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)], strict=True))
                out.append((None if absent else doc_id, len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            columns = zip(*out, strict=True) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    joined = joined_few(rows, spans, ["doc_id", "text_hash"], "left").select("doc_id", "absent", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with repeated passages cut from the text; a character that is covered in part stays, null stays null."""
    spans = gathered(repeats(keyed(docs, id_col, text_col), length, **how))
    doc_id, text = key_columns(id_col, text_col)

    @F.pandas_udf("string")
    def cut(texts, lists):
        import pandas as pd

        out = []
        for text_, spans_ in zip(texts, lists, strict=True):
            if text_ is None or spans_ is None or not len(spans_):
                out.append(text_)
                continue
            raw, kept, at = text_.encode("utf-8", "replace"), [], 0
            for a, b in zip(*(x.tolist() for x in runs(spans_)), strict=True):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                kept.append(raw[at:a])
                at = b
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
        return pd.Series(out)

    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    joined = joined_few(own, spans, ["doc_id", "text_hash"], "left")
    kept = F.when(F.col("spans").isNull(), F.col(f"row.`{text_col}`")).otherwise(cut(F.col(f"row.`{text_col}`"), F.col("spans")))
    return joined.select(*[kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


QUERIES = {"op3_prefix_free_parsing": op3_prefix_free_parsing}
ORACLES: dict[str, str] = {}
