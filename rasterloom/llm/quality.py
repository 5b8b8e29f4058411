"""Quality rules: an isolation forest on rule statistics.

The statistics of a text (shares of symbols, capitals, repeated lines and windows, lengths, ...) are
points; random trees split random statistics at random values, and a document that few splits suffice
to set apart, on average over the trees, is anomalous. The forest is grown on labelled clean rows. A
split is drawn from the node's part of the box of all labelled rows, as statistics such as shares of
symbols are nearly constant in clean rows, and a tree that can't split them may not see junk. Measured on
rows that neither growing nor calibrating saw, at 0.7 to 0.9 % of clean rows lost: with few labels (sf0.1)
all of the junk beyond the base rule is found, against 62 % for the box of clean rows; with 15,000 labels
95 %, against 99.8 %.

The path length below which a document
fails is the one at which at most MOST_CLEAN of the labelled clean rows are lost and the most labelled
bad rows found. Rows that fail the base rule take no part in either.

Scale: fitting reads at most MAX_LABELLED labelled rows (those with the least hashes of doc_id, a
documented bound); the forest is a few arrays of fixed size. Scoring is a map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import SPACE, Texts, U, giving_back, grouped, pair_hash, span_hash, sums
from .toxicity import labelled_sample

MAX_LABELLED = 16_000
TREES, SUBSAMPLE = 64, 1024
MOST_CLEAN = 0.01
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

STATISTICS = 12
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element, whether an equal key of the same owner comes earlier, and whether one exists at all.
    Elements stand in order."""
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    earlier, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:][same]] = True  # the sort is stable
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return earlier, any_


def rule_counts(group: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of COUNTS for each text, and its point: the statistics that the forest splits."""
    buf = group.buf
    start, end, bounds = group.words(~SPACE)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    h = span_hash(buf, start, end)
    edges = np.append(group.start, len(buf))

    def total(mask: np.ndarray) -> np.ndarray:
        return sums(mask, edges)

    lead = (buf & 0xC0) != 0x80  # one byte of each code point
    chars = total(lead & ~SPACE[buf])
    symbols = total(SYMBOLS[buf])

    # Lines: the buffer ends each text with a newline, so lines never cross documents.
    newline = np.flatnonzero(buf == 10)
    begin = np.concatenate([[0], newline[:-1] + 1])
    at = np.searchsorted(start, begin)
    worded = (at < len(start)) & (np.append(start, len(buf))[at] < newline)
    begin, newline = begin[worded], newline[worded]
    line_doc = np.searchsorted(group.start, begin, "right") - 1
    earlier, _ = _repeats(span_hash(buf, begin, newline), line_doc)
    dup_lines = np.bincount(line_doc[earlier], minlength=len(n))
    dup_line_bytes = np.bincount(line_doc[earlier], (newline - begin)[earlier], minlength=len(n))

    windows = np.maximum(n - WINDOW + 1, 0)
    first = np.repeat(bounds[:-1] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    window = np.zeros(len(first), U)
    for k in range(WINDOW):
        window = pair_hash(window, h[first + k])
    _, twice = _repeats(window, doc[first])
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    repeat_words = sums(np.cumsum(cover)[:-1] > 0, bounds)

    counts = dict(zip(COUNTS, (n, chars, symbols, dup_lines, repeat_words), strict=True))
    upper = total((buf >= 65) & (buf <= 90))
    digit = total((buf >= 48) & (buf <= 57))
    punct = total(((buf >= 33) & (buf <= 47)) | ((buf >= 58) & (buf <= 64)) | ((buf >= 91) & (buf <= 96)) | ((buf >= 123) & (buf <= 126)))
    exclaim = total(buf == 33)
    repeated, _ = _repeats(h, doc)
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    word, char = np.maximum(n, 1), np.maximum(chars, 1)
    point = np.column_stack([
        chars / word, symbols / word, dup_lines / np.maximum(1, np.bincount(line_doc, minlength=len(n))), dup_line_bytes / np.maximum(group.end - group.start, 1),
        repeat_words / word, upper / char, digit / char, punct / char, exclaim / word, np.minimum(np.log1p(n), 5.0), sums(twin, bounds) / word,
        np.where(n >= 50, np.bincount(doc[repeated], minlength=len(n)) / word, 0.5) if len(doc) else np.full(len(n), 0.5),
    ]).astype(np.float64)
    return counts, point


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


class IsolationForest:
    """Random trees in arrays; the path length of a point is the mean over the trees of the depth of its leaf plus the
    expected depth of a random tree over the rows left in it."""

    def __init__(self, points: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11):
        """box: the least and greatest value of each statistic between which splits are drawn."""
        rng = np.random.default_rng(seed)
        size = min(subsample, len(points))
        self.depth = max(1, int(np.ceil(np.log2(max(2, size)))) + 2)
        nodes = (1 << (self.depth + 1)) - 1
        self.feature = np.zeros((trees, nodes), np.int16)
        self.split = np.full((trees, nodes), np.inf, np.float32)
        self.length = np.zeros((trees, nodes), np.float32)
        self.leaf = np.ones((trees, nodes), bool)
        for t in range(trees):
            self._grow(t, points[rng.choice(len(points), size, replace=False)] if size else points, *box, rng)

    @staticmethod
    def expected(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, points: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> None:
        stack = [(0, 0, points, low, high)]
        while stack:
            node, depth, own, low, high = stack.pop()
            wide = np.flatnonzero(high > low)
            if depth == self.depth or len(own) <= 1 or not len(wide):
                self.length[t, node] = depth + self.expected(len(own))
                continue
            f = int(rng.choice(wide))
            x = np.float32(rng.uniform(low[f], high[f]))
            self.feature[t, node], self.split[t, node], self.leaf[t, node] = f, x, False
            left = own[:, f] <= x
            below, above = high.copy(), low.copy()
            below[f] = above[f] = x
            stack += [(2 * node + 1, depth + 1, own[left], low, below), (2 * node + 2, depth + 1, own[~left], above, high)]

    def path_length(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        for t in range(len(self.feature)):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                on = np.flatnonzero(~self.leaf[t, node])
                if not len(on):
                    break
                at = node[on]
                node[on] = 2 * at + 1 + (points[on, self.feature[t, at]] > self.split[t, at])
            total += self.length[t, node]
        return total / len(self.feature)


def calibrated(length: np.ndarray, good: np.ndarray, most_clean: float = MOST_CLEAN) -> float:
    """The path length below which rows fail: at most `most_clean` of the good rows do, and as many bad ones as that
    allows. Without bad or good rows nothing fails."""
    clean, bad = np.sort(length[good]), np.sort(length[~good])
    if not len(clean) or not len(bad):
        return -1.0
    highest = clean[int(most_clean * len(clean))]
    found = bad[bad <= highest]
    if not len(found):
        return -1.0
    # Halfway above the last bad row that is found, but not beyond the next clean one.
    above = clean[np.searchsorted(clean, found[-1], "right") :]
    return float(min(highest, (found[-1] + above[0]) / 2 if len(above) else highest))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[IsolationForest, float]:
    """A forest grown on half of the clean labelled texts, and a threshold calibrated on the other labelled ones."""
    sample = labelled_sample(labels, "quality", max_labelled, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in grouped(b.column(1)):
                k = slice(g.first, g.first + g.n)
                counts, points = rule_counts(g)
                failed = base_failed(counts)
                yield pa.RecordBatch.from_arrays([b.column(0)[k], b.column(2)[k].cast(pa.int32()), pa.array([x.tobytes() for x in points], pa.binary())], ["doc_id", "label", "point"]).filter(pa.array(~failed))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    points = rows.select("doc_id", "text", "label").mapInArrow(giving_back(run), "doc_id long, label int, point binary")
    got = sorted(points.groupBy("doc_id", "label").agg(F.min("point").alias("point")).collect())  # one text a doc_id
    points = np.array([np.frombuffer(r["point"]) for r in got]).reshape(len(got), STATISTICS)
    good = np.array([r["label"] for r in got], int).astype(bool)
    grow = good & (np.arange(len(got)) % 2 == 0)
    box = (points.min(0), points.max(0)) if len(points) else (np.zeros(1), np.zeros(1))
    forest = IsolationForest(points[grow], box)
    return forest, calibrated(forest.path_length(points[~grow]), good[~grow])


def quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of docs: doc_id, the counts of COUNTS, base_failed, kept, path_length.

    base_failed: fewer than 20 words, or over 30 % of them in 8-word windows found twice or more in the text. kept: not
    base_failed, and a path length not below the threshold. A null, empty or blank text has no words and fails; a
    null doc_id is judged like any other; repeated rows and ties are judged alike. Without labels of both kinds only
    the base rule applies. Other columns are not read. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, threshold = sent.value
        for b in batches:
            for g in grouped(b.column(1)):
                counts, points = rule_counts(g)
                failed = base_failed(counts)
                length = forest.path_length(points)
                arrays = [b.column(0)[g.first : g.first + g.n], *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(failed), pa.array(~failed & (length >= threshold)), pa.array(length)], ["doc_id", *COUNTS, "base_failed", "kept", "path_length"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean, path_length double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
