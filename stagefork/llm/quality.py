"""Quality classifier: a byte-level convolutional network in numpy.

Every window of WIDTH bytes, one every STRIDE bytes so that windows overlap and
cover the whole document, goes through FILTERS learned filters. A filter's largest
response over all windows is one feature; a logistic layer with one hidden step
combines the features into a probability. Training uses Adam on a bounded sample of
labelled rows; the gradient of a maximum reaches one window a filter and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import id_remainder, slices, table

WIDTH, STRIDE, FILTERS, HIDDEN = 8, 4, 24, 16
#: Labelled rows that training takes at most, in order of a hash of their id.
MOST_ROWS = 5000
EPOCHS, BATCH, RATE = 12, 50, 0.01
THRESHOLD = 0.3
#: Bytes whose windows are worked on at a time.
PIECE = 1 << 18


def window_starts(n: int) -> int:
    """Number of windows over n bytes; the last one may reach beyond the end, into zeros."""
    return max(1, -(-(n - WIDTH) // STRIDE) + 1)


@dataclass
class Network:
    """Filters as one table a byte position, and the layers that combine their maxima."""

    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        f32 = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        return cls(f32(WIDTH, 256, FILTERS, by=0.1), np.zeros(FILTERS, np.float32), f32(FILTERS, HIDDEN, by=FILTERS**-0.5),
                   np.zeros(HIDDEN, np.float32), f32(HIDDEN, by=HIDDEN**-0.5), np.zeros(1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def responses(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = self.filters[0].take(data[starts], axis=0)
        for k in range(1, WIDTH):
            z += self.filters[k].take(data[starts + k], axis=0)
        return z

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum for each document, and where in the joined bytes its window starts."""
        best = np.full((len(texts), FILTERS), -np.inf, np.float32)
        where = np.zeros((len(texts), FILTERS), np.int64)
        padded = [t + bytes((window_starts(len(t)) - 1) * STRIDE + WIDTH - len(t)) for t in texts]
        bounds = np.cumsum([0, *map(len, padded)])
        data = np.frombuffer(b"".join(padded), np.uint8)
        counts = np.array([window_starts(len(t)) for t in texts])
        doc = np.repeat(np.arange(len(texts)), counts)
        starts = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE + bounds[doc]
        for at in range(0, len(starts), PIECE // STRIDE):
            own, s = doc[at:at + PIECE // STRIDE], starts[at:at + PIECE // STRIDE]
            z = self.responses(data, s)
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            top = np.maximum.reduceat(z, first, axis=0)
            for d, lo, hi, m in zip(own[first], first, [*first[1:], len(own)], top, strict=True):
                more = m > best[d]
                if more.any() and self.track:
                    where[d, more] = s[lo + z[lo:hi, more].argmax(axis=0)]
                best[d] = np.maximum(best[d], m)
        self.data = data
        return best + self.bias, where

    track = False
    data: np.ndarray | None = None

    def combine(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.tanh(pooled)
        h = np.tanh(a @ self.hidden + self.hidden_bias)
        return a, h, 1 / (1 + np.exp(-(h @ self.out + self.out_bias)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Equal texts score alike whatever stands beside them: maxima don't hang on it, and each row's sums run over FILTERS and HIDDEN terms in order."""
        if not texts:
            return np.zeros(0)
        a = np.tanh(self.pooled(texts)[0].astype(np.float64))
        h = np.tanh((a[:, :, None] * self.hidden).cumsum(axis=1)[:, -1] + self.hidden_bias)
        return 1 / (1 + np.exp(-((h * self.out).cumsum(axis=1)[:, -1] + self.out_bias[0])))


def train(texts: list[bytes], labels: list[int], seed: int = 0) -> Network:
    """A network for the labels; without both labels it answers their smoothed share alone."""
    net = Network.start(seed)
    net.track = True
    y = np.array(labels, np.float32)
    net.out_bias[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.track = False
        return net
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    rng, step = np.random.default_rng(seed + 1), 0
    batches = -(-len(texts) // BATCH)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for b in range(batches):
            own = order[b::batches]
            pooled, where = net.pooled([texts[i] for i in own])
            a, h, p = net.combine(pooled)
            wrong = (p - y[own]) / len(own)
            into_h = np.outer(wrong, net.out) * (1 - h * h)
            into_a = into_h @ net.hidden.T * (1 - a * a)
            filters = np.zeros_like(net.filters)
            column = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                np.add.at(filters[k], (net.data[where + k], column), into_a)
            grads = [filters, into_a.sum(axis=0), a.T @ into_h, into_h.sum(axis=0), h.T @ wrong, wrong.sum(keepdims=True)]
            step += 1
            rate = RATE * (1 - 0.9 * (epoch * batches + b) / (EPOCHS * batches))
            for w, g, (m, v) in zip(net.weights(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    net.track = False
    net.data = None
    return net


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[list[bytes], list[int]]:
    """The whole texts of at most `most` labelled rows, in order of a hash of their id: a bounded sample for the driver."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    # Ids are matched without texts, so that only the chosen rows' texts move.
    matched = own.select("_id").join(marks.select(F.col(id_col).cast("long").alias("_id"), "_label"), "_id")
    chosen = matched.withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(most).distinct()
    rows = own.join(F.broadcast(chosen), "_id")  # `most` rows at most
    found = rows.orderBy("_order", "_id", F.xxhash64("_text")).limit(most).select("_text", "_label").collect()
    return [bytes(r["_text"]) for r in found], [r["_label"] for r in found]


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row; a null text counts as empty, which is one window of zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = shared.value.score([t or b"" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(of, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_ROWS) -> Network:
    """A network from the labelled documents whose crc32(id) mod 5 isn't 0.

    Labels other than 0 and 1 and null ids are left out; with no labelled row at all,
    every text scores one half.
    """
    learn = labels.where(id_remainder(F.col(id_col), 5) != 0)
    return train(*training_rows(docs, learn, id_col, text_col, label_col, most))


def accepted(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` whose text scores `threshold` or more, with all their columns.

    A null text counts as empty and is scored like it; repeated rows stay or go together,
    and other columns aren't read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            texts = [t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
            kept = batch.filter(pa.array(shared.value.score(texts) >= threshold))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(of, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; only the text is read for a score.

    Rows with equal texts have equal scores whatever their ids, which may be null or
    repeat. An empty table gives no rows; further columns are not read.
    """
    rows = scored(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return rows.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
