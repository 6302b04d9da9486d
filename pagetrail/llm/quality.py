"""Ordinal quality classifier: one hashed-text weight vector, ordered thresholds.

Cumulative links: P(grade <= k) = sigmoid(threshold_k - w.x), thresholds ascending, w shared by all
grades. The weights are fitted on a bounded sample of the labelled rows (`SAMPLE`, those with the
smallest hashes of their id); every document is then scored in one pass over whole texts. Scores are
the expected grade and the tail probability of the top grade, and a document is kept when that
probability reaches `keep_at`.

Grades of `labels`: 0 toxic, 1 clean but of low quality, 2 fine and clean. Only the ends of the scale
can be told apart without limit, and toxic words must weigh as much as they can.

Defined results: null text counts as empty; a document labelled several times takes its lowest
grade; rows with a null label are not used; without any labelled row nothing is rejected and scores
are null; equal texts score alike; columns besides id and text are carried along by `select_quality`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm.batches import pieces
from pagetrail.llm.shared import table

#: Labelled rows used for fitting, at most; buckets of the hashed features.
SAMPLE, BUCKETS = 16_000, 1 << 18
KEEP_AT = 0.5
#: Bytes of the beginnings of longer words that are features too.
STEMS = (4, 6)
PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
#: Byte classes whose share of a text is a feature.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"&$%*#", b"|", b".,", b"\n", b" ", b"<>{}[]=\\/")
_CLASS_OF = np.zeros(256, np.int64)
for _k, _chars in enumerate(CLASSES, 1):
    _CLASS_OF[list(_chars)] = _k


def _level(share: float) -> int:
    """Halves of a share: 0 for none, larger for more."""
    return 0 if share <= 0 else max(1, 12 + int(np.floor(np.log2(min(share, 1.0)) * 1.5)))


def features(text: str | None) -> np.ndarray:
    """Buckets of the distinct words of a text, their beginnings and its shape, ascending."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().translate(None, PUNCTUATION).split()
    hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    stems = {w[:n] + b"-" for w in set(words) for n in STEMS if len(w) > n}
    shape = np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[1:] / max(1, len(raw))
    distinct = np.unique(hashed)
    marks = [*shape, float((hashed[1:] == hashed[:-1]).mean()) if len(words) > 1 else 0.0, 1 - len(distinct) / max(1, len(words))]
    named = [zlib.crc32(b"shape %d %d" % (k, _level(v))) for k, v in enumerate(marks)]
    named.append(zlib.crc32(b"length %d" % len(words).bit_length()))
    named += map(zlib.crc32, stems)
    return np.unique(np.concatenate([distinct, np.array(named, np.uint32)]) % BUCKETS).astype(np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def loss(score: np.ndarray, y: np.ndarray, theta: np.ndarray) -> float:
    """Mean negative logarithm of the likelihood of grades y."""
    edges = np.r_[-np.inf, theta, np.inf]
    return float(-np.log(_sigmoid(edges[y + 1] - score) - _sigmoid(edges[y] - score)).mean())


def slopes(score: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of loss() by each score and by each threshold."""
    top = len(theta)
    upper = np.where(y < top, _sigmoid(theta[np.minimum(y, top - 1)] - score), 1.0)
    lower = np.where(y > 0, _sigmoid(theta[np.maximum(y - 1, 0)] - score), 0.0)
    p = (upper - lower).clip(1e-12)
    up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
    by = np.bincount(np.minimum(y, top - 1), -up * (y < top), top) + np.bincount(np.maximum(y - 1, 0), low * (y > 0), top)
    return (up - low) / len(y), by / len(y)


@dataclass
class Ordinal:
    """Fitted by AdaGrad on the likelihood of the grades; x is binary, so w.x is a sum of weights."""

    grades: int = 3
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.3, ridge: float = 1e-5) -> Ordinal:
        scale = self.telling(rows, y)
        share = np.array([(y <= k).mean() for k in range(self.grades - 1)]).clip(0.01, 0.99)
        theta = np.sort(np.log(share / (1 - share))) + 1e-3 * np.arange(self.grades - 1)
        base, steps = theta[0], np.log(np.diff(theta).clip(1e-3))  # thresholds stay ordered: gaps are exp(steps)
        sums, base_sum, step_sums, order = np.full(BUCKETS, 1e-6), 1e-6, np.full(len(steps), 1e-6), np.random.default_rng(0)
        for _ in range(epochs):
            mixed = order.permutation(len(rows))
            for i in range(0, len(mixed), batch):
                part = mixed[i : i + batch]
                ids, sizes = np.concatenate([rows[j] for j in part]), np.array([len(rows[j]) for j in part])
                score = np.add.reduceat((self.weights * scale)[ids], np.r_[0, np.cumsum(sizes)[:-1]])
                slope, tail = slopes(score, y[part], base + np.r_[0, np.cumsum(np.exp(steps))])
                gradient = np.bincount(ids, np.repeat(slope, sizes), BUCKETS) * scale + ridge * self.weights
                sums += gradient**2
                self.weights -= rate * gradient / np.sqrt(sums)
                tail = np.cumsum(tail[::-1])[::-1]  # a threshold moves all above it
                base_sum, step_sums = base_sum + tail[0] ** 2, step_sums + (tail[1:] * np.exp(steps)) ** 2
                base -= rate * tail[0] / np.sqrt(base_sum)
                steps -= rate * tail[1:] * np.exp(steps) / np.sqrt(step_sums)
        self.thresholds, self.weights = base + np.r_[0, np.cumsum(np.exp(steps))], self.weights * scale
        return self

    def telling(self, rows: list[np.ndarray], y: np.ndarray, least: float = 3.0, full: float = 8.0) -> np.ndarray:
        """0 to 1 for each bucket: how surely its share differs above and below some cut of the grades."""
        best = np.zeros(BUCKETS)
        ids, of = np.concatenate(rows), np.repeat(y, [len(r) for r in rows])
        for k in range(self.grades - 1):
            above, below = max(1, int((y > k).sum())), max(1, int((y <= k).sum()))
            up, low = np.bincount(ids[of > k], minlength=BUCKETS), np.bincount(ids[of <= k], minlength=BUCKETS)
            share = (up + low) / (above + below)
            spread = np.sqrt((share * (1 - share) * (1 / above + 1 / below)).clip(1e-12))
            best = np.maximum(best, np.abs(up / above - low / below) / spread)
        return ((best - least) / (full - least)).clip(0, 1)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return _sigmoid(score[:, None] - self.thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from labels(doc_id, quality, toxic)."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """A model from at most `sample` rows of grades(doc_id, grade); of rows that share an id the one with the smallest features is used."""
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("label_id"), "grade")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, 2):
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["label_id", "grade", "ids"])

    # the chosen labels are bounded by the sample, and so is what comes back
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    made = picked.select("label_id", "grade", "text").mapInArrow(run, "label_id long, grade int, ids array<int>")
    got = made.groupBy("label_id").agg(F.min(F.struct("grade", "ids")).alias("m")).select("m.grade", "m.ids").toArrow()
    y = np.array(got.column("grade").to_pylist(), np.int64)
    if not len(y):
        return None
    lists = got.column("ids").combine_chunks()
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    order = sorted(range(len(y)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes()))  # the same order however Spark returns them
    return Ordinal().fit([rows[i] for i in order], y[order])


def scored(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept: a row per document."""
    if model is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights, thresholds = shared.value
        own = Ordinal(len(thresholds) + 1, weights, thresholds)
        for batch in pieces(batches, 1):
            score = np.array([weights[features(t)].sum(dtype=np.float64) for t in batch.column(1).to_pylist()])
            tails = np.round(own.tails(score), 6)
            kept = tails[:, -1] >= keep_at
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(tails.sum(axis=1), 6)), pa.array(tails[:, -1]), pa.array(kept)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def select_quality(docs: DataFrame, model: Ordinal | None, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns and in one pass."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), float(model.thresholds[-1])))

    @F.pandas_udf("boolean")
    def keeps(texts):
        import pandas as pd

        weights, top = shared.value
        score = np.array([weights[features(t)].sum(dtype=np.float64) for t in texts])
        return pd.Series(np.round(_sigmoid(score - top), 6) >= keep_at)

    return docs.filter(keeps(F.col(text_col).cast("string")))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, graded(table(spark, sf_dir, "labels"))))


QUERIES = {"op1_ordinal_quality": op1_ordinal_quality}
ORACLES: dict[str, str] = {}
