"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The join walks pairs of trie nodes from the root down: children are paired, a differing bit is
charged, and a pair is dropped as soon as it has spent more than the allowed distance.

Scale: distinct fingerprints only (copies share one). Two within distance d agree on at least one of
d + 1 blocks of bits. So for each block the trie is built with that block's bits at the top, where
nothing may be spent: its subtrees below the block are dealt out by the block's value, d + 1 rows a
fingerprint whatever the input, and walked on their own. A value that more than HOT fingerprints share
is split by blocks of the remaining bits in the same way. A task walks all of its node pairs of a
level at once, up to a bound, folds pairs into classes as they are found, and emits a spanning forest,
at most one link a fingerprint and block, so dense groups of copies take no more memory or rows. Components are then found by alternating large-star and small-star
steps, which are equi-joins with partial minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import LOWER, SPACE, Texts, U, giving_back, grouped, sums, xxh64
from .shared import materialize

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Fingerprints that may share a block's value before it is split again; rows of a task.
HOT, TASK_ROWS = 50_000, 400_000


def fingerprints(group: Texts, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text of the group."""
    buf = LOWER[group.buf]
    space = SPACE[buf]
    keep = ~space
    keep[1:] |= ~space[:-1]  # one space after each word
    # Blank texts keep nothing, so places in the new buffer are counts of what is kept.
    place = np.concatenate([[0], np.cumsum(keep)])
    joined = buf[keep]
    joined[SPACE[joined]] = 32
    start, end, bounds = group.words(~SPACE)
    start, end = place[start], place[end]
    n = np.diff(bounds)
    shingles = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.repeat(bounds[:-1] - np.cumsum(shingles) + shingles, shingles) + np.arange(shingles.sum())
    last = np.minimum(first + shingle, np.repeat(bounds[1:], shingles)) - 1
    h = xxh64(joined, start[first], end[last], seed) if len(first) else np.zeros(0, U)
    edges = np.concatenate([[0], np.cumsum(shingles)])
    out = np.zeros(len(n), U)
    for bit in range(64):
        ones = sums(((h >> U(bit)) & U(1)).astype(np.uint8), edges)
        out |= (2 * ones > shingles).astype(U) << U(bit)
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprints(g, shingle, seed) for g in grouped(b.column(1))]
            fp = np.concatenate(fp).view(np.int64) if fp else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, fp long")


#: Pairs of nodes that a frontier of the walk holds; pairs of fingerprints that its leaves give at once are up to LEAF times that.
FRONTIER, LEAF = 1 << 16, 16


def trie_pairs(a: np.ndarray, distance: int = DISTANCE, top: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (i, j), i < j, of the sorted uint64 that differ in at most `distance` bits, and in none of the first `top`,
    in arrays of bounded size. No pair comes twice.

    A node is a range of a; the walk starts from the pairs (node, node) of level `top`.
    """
    head = a >> U(64 - top) if top else np.zeros(len(a), U)
    lo = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(a) else np.zeros(0, np.int64)
    hi = np.append(lo[1:], len(a)).astype(np.int64)
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    # A stack of frontiers (level, node ranges, bits spent), cut so that memory stays bounded.
    stack = [(top, *(x[k : k + FRONTIER] for x in (lo, hi, lo, hi, np.zeros(len(lo), np.int64)))) for k in range(0, len(lo), FRONTIER)]
    while stack:
        level, alo, ahi, blo, bhi, spent = stack.pop()
        small = (ahi - alo) * (bhi - blo) <= LEAF if level < 64 else np.ones(len(alo), bool)
        if small.any():
            lo, m, other, n = alo[small], (ahi - alo)[small], blo[small], (bhi - blo)[small]
            size = m * n
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = np.repeat(lo, size) + k // np.repeat(n, size), np.repeat(other, size) + k % np.repeat(n, size)
            near = (i < j) & (np.bitwise_count(a[i] ^ a[j]) <= distance)
            yield i[near], j[near]
            if small.all():
                continue
            alo, ahi, blo, bhi, spent = (x[~small] for x in (alo, ahi, blo, bhi, spent))
        amid, bmid = _split(a, alo, ahi, level), _split(a, blo, bhi, level)
        parts = [(alo, amid, blo, bmid, spent), (amid, ahi, bmid, bhi, spent), (alo, amid, bmid, bhi, spent + 1), (amid, ahi, blo, bmid, spent + 1)]
        own = alo == blo  # below one node, (x, y) and (y, x) are one pair
        parts[3] = tuple(x[~own] for x in parts[3])
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        ok = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= distance)
        nxt = [x[ok] for x in nxt]
        for k in range(0, len(nxt[0]), FRONTIER):
            stack.append((level + 1, *(x[k : k + FRONTIER] for x in nxt)))


def _split(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where bit 63 - level turns to 1 in each range: all of its values share the bits above."""
    bit = U(1) << U(63 - level)
    head = a[lo] & ~((bit << U(1)) - U(1)) if level else np.zeros(len(lo), U)
    return np.clip(np.searchsorted(a, head | bit), lo, hi)


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, the least node of each one's class, after the links (i, j): minima pass on, then pointers jump."""
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        differ = low < high
        if not differ.any():
            break
        i, j = i[differ], j[differ]
        np.minimum.at(root, high[differ], low[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(a: np.ndarray, distance: int = DISTANCE, top: int = 0) -> np.ndarray:
    """For each of the sorted uint64 the least one (as index) that links of trie_pairs lead to. Pairs are folded in as
    the walk finds them, so a dense bucket takes no more memory than a sparse one."""
    root = np.arange(len(a))
    for i, j in trie_pairs(a, distance, top):
        root = joined(root, i, j)
    return root


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first, size) of `parts` blocks of about equal size."""
    edge = [bits * k // parts for k in range(parts + 1)]
    return [(i, j - i) for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _turned(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def near_links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (u, v) of the distinct long fp of fps: a forest with the components of `within distance`."""
    blocks = _blocks(64, distance + 1)
    heads = [
        F.struct(F.lit(k).alias("block"), F.lit(size).alias("top"), _turned(F.col("fp"), first).alias("turned"), F.shiftrightunsigned(_turned(F.col("fp"), first), 64 - size).alias("head"))
        for k, (first, size) in enumerate(blocks)
    ]
    rows = fps.select(F.explode(F.array(*heads)).alias("x")).select("x.*")
    crowded = materialize(rows.groupBy("block", "head").count().where(F.col("count") > hot).select("block", "head", F.lit(True).alias("crowded")), "crowded")
    n = fps.count()
    if not crowded.isEmpty():
        rows = rows.join(crowded, ["block", "head"], "left")
        cases = F.when(F.col("crowded").isNull(), F.array(F.struct(F.col("turned"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("low"))))
        for k, (_, size) in enumerate(blocks):
            # The remaining bits, in blocks of their own: one must agree too.
            parts = [
                F.struct(F.col("turned"), F.lit(p).alias("part"), F.shiftrightunsigned(F.shiftleft("turned", size + first), 64 - width).alias("low"))
                for p, (first, width) in enumerate(_blocks(64 - size, distance + 1))
            ]
            cases = cases.when(F.col("block") == k, F.array(*parts))
        rows = rows.withColumn("x", F.explode(cases)).select("block", "top", "head", "x.*")
        keys = ["block", "head", "part", "low"]
    else:
        keys = ["block", "head"]
    tasks = max(1, -(-n * len(blocks) // task_rows), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    dealt = rows.repartition(tasks, *keys).select("block", "turned")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches]
        if not got:
            return
        block, turned = (np.concatenate(x) for x in zip(*got, strict=True))
        for k, (first, size) in enumerate(blocks):
            a = np.unique(turned[block == k])
            root = forest(a, distance, size)
            fp = a if first == 0 else (a >> U(first)) | (a << U(64 - first))
            linked = np.flatnonzero(root != np.arange(len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(giving_back(join), "u long, v long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in links (u, v): component is its least node.

    Large-star links each node's larger neighbours with its least one, small-star does so for the smaller;
    they alternate until nothing changes, about log(nodes) rounds. Each round's links are written to the shared
    folder, at most one row a link.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            least = edges.groupBy("u").agg(F.min("v").alias("m"))
            own = edges.join(least, "u")
            out = own.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = state(edges)
    for _ in range(most_rounds):
        edges = materialize(star(star(edges, True), False), "stars")
        now = state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id, n_links.

    Words are runs of non-space bytes after lower-casing A-Z; shingles count with repeats; a text of fewer words is one
    shingle; one without words (null, empty, blank) has fingerprint zero and is linked like any other. component_id is
    the least doc_id reachable through links of at most `distance` bits, n_links the forest links of its
    fingerprint's component. Equal texts share a fingerprint; repeated rows and ties are separate rows of one
    component; a null doc_id is a row but never a component_id unless all are null. Other columns are not read.
    An empty table gives an empty result.
    """
    rows = materialize(fingerprint_table(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(near_links(fps, distance))
    groups = materialize(
        fps.join(groups, fps["fp"] == groups["node"], "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("component")),
        "components",
    )
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"), (F.count("*") - 1).alias("n_links"))
    groups = groups.join(least, "component").select("fp", "component_id", "n_links")
    return rows.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
