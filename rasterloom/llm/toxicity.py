"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of adjacent pairs, and of pairs with one
word between, in 2**DIM_BITS dimensions. FTRL-proximal keeps two numbers a coordinate: z, the
gradients gathered, and n, their squares, which sets the coordinate's own learning rate; a weight is
zero while |z| stays within l1, so few weights are left, and those are broadcast for scoring.

Scale: fitting reads at most MAX_TRAIN labelled rows, those with the least hashes of doc_id, one text
a doc_id, and of these no more after MAX_FEATURES features (documented bounds, so the one fitting
task and the broadcast sample don't grow); scoring is a map over all whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, Texts, U, giving_back, grouped, pair_hash, span_hash, sums

DIM_BITS = 20
MAX_TRAIN, MAX_FEATURES = 16_000, 1 << 26
THRESHOLD = 0.3


def features(group: Texts, dim_bits: int = DIM_BITS, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes of the group's texts, each once a text, one text after the other, and the bounds of each text's.

    Case and punctuation don't count. With used (a mask), only those indexes.
    """
    buf = LOWER[group.buf]
    start, end, bounds = group.words(ALNUM, buf)
    h = span_hash(buf, start, end)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    parts, owners = [h], [doc]
    for gap, salt in ((1, U(11)), (2, U(13))):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append(pair_hash(h[:-gap][same] + salt, h[gap:][same]))
            owners.append(doc[gap:][same])
    index = (np.concatenate(parts) >> U(64 - dim_bits)).astype(np.int64)
    owner = np.concatenate(owners)
    if used is not None:
        keep = used[index]
        index, owner = index[keep], owner[keep]
    key = np.unique(owner << dim_bits | index)
    return (key & ((1 << dim_bits) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(n) + 1) << dim_bits)


class Ftrl:
    """FTRL-proximal over sparse binary features; coordinate 2**dim_bits is the bias."""

    def __init__(self, dim_bits: int = DIM_BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << dim_bits) + 1), np.zeros((1 << dim_bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.abs(z) > np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(free, (np.sign(z) * self.l1 * (at < len(self.z) - 1) - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.z)
        w = self.weights(at)
        return at[w != 0], w[w != 0]


def stable_hash(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))


def labelled_sample(labels: DataFrame, label: str, rows: int, salt: str = "") -> DataFrame:
    """At most `rows` of (doc_id, label), those with the least hash. Rows without a label or doc_id give none; of
    repeated doc_ids the largest label counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return known.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, epochs: int = 2, dim_bits: int = DIM_BITS, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights (places, values) from the texts of docs with a label in (doc_id, toxic). Of several texts of a doc_id
    the one whose features come first counts."""
    sample = labelled_sample(labels, "toxic", max_train)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in grouped(b.column(1)):
                index, bounds = features(g, dim_bits)
                k = slice(g.first, g.first + g.n)
                lists = [index[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[k], b.column(2)[k].cast(pa.int32()), pa.array(lists, pa.binary())], ["doc_id", "label", "index"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, xs, room = [], [], [], max_features
        for b in batches:
            for own, label, index in zip(*(c.to_pylist() for c in b.columns), strict=True):
                room -= len(index) // 4
                if room >= 0:
                    ids.append(own)
                    ys.append(label)
                    xs.append(np.frombuffer(index, np.int32))
        model = Ftrl(dim_bits)
        order = sorted(range(len(ids)), key=lambda k: (ids[k], len(xs[k])))  # however the rows come
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for k in rng.permutation(order):
                model.learn(xs[k], ys[k])
        at, w = model.sparse()
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int64).tobytes()]), pa.array([w.astype(np.float64).tobytes()])], ["at", "w"])

    rows = texts.select("doc_id", "text", "label").mapInArrow(giving_back(extract), "doc_id long, label int, index binary")
    rows = rows.groupBy("doc_id", "label").agg(F.min("index").alias("index"))
    got = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(giving_back(train), "at binary, w binary").collect()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.frombuffer(got[0]["at"], np.int64), np.frombuffer(got[0]["w"], np.float64)


def scorer(at: np.ndarray, w: np.ndarray, dim_bits: int = DIM_BITS) -> Callable[[pa.Array], np.ndarray]:
    """Scores of a column of texts, from sparse weights."""
    dense = np.zeros((1 << dim_bits) + 1)
    dense[at] = w
    used = dense != 0

    def score(texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for g in grouped(texts):
            index, bounds = features(g, dim_bits, used)
            out.append(1.0 / (1.0 + np.exp(-np.clip(sums(dense[index], bounds) + dense[-1], -35, 35))))
        return np.concatenate(out)

    return score


def score_texts(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], dim_bits: int = DIM_BITS) -> DataFrame:
    """(doc_id, score) of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*sent.value, dim_bits)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(giving_back(run), "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, dim_bits: int = DIM_BITS) -> DataFrame:
    """The rows of docs whose text isn't predicted toxic, with all their columns, in one pass without a shuffle.

    A null or empty text has no features and stays unless the base rate alone reaches the threshold; rows with a null
    doc_id are judged by their text, repeated rows and ties alike. Without any label to learn from all rows stay. An empty
    table gives an empty result.
    """
    weights = fit(docs, labels.where(~held_out()), max_train, dim_bits=dim_bits)
    if not len(weights[0]):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*sent.value, dim_bits)
        for b in batches:
            yield b.filter(pa.array(score(b.column(place)) < threshold))

    return docs.mapInArrow(giving_back(run), docs.schema)


def held_out() -> Column:
    return F.coalesce(stable_hash(F.col("doc_id")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Learns from labels whose crc32(doc_id) mod 4 isn't 2. A null or empty text has no features and gets the
    model's base rate; a null doc_id is scored and not held out; repeated rows and ties score alike. Without any label
    every score is 0.5. Other columns are not read. An empty table gives an empty result.
    """
    weights = fit(docs, labels.where(~held_out()), max_train)
    scored = score_texts(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
