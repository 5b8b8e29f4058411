"""Near copies by an exact similarity join: texts whose sets of 5-word shingles have Jaccard similarity 0.8 or more.

The nearest copies come from the trie join of fingerprints. Those of 64 bits can't give all: at this similarity they lie
about ten bits apart, where a trie's subtrees no longer get small. The other candidates come from prefixes. All shingles
have one order; a set's prefix is its first n - ceil(0.8 n) + 1 shingles, and two sets as similar as
asked share one of their prefixes' shingles. So no pair is missed, and each candidate is then compared in full. In
the order shingles that only one text has stand first, so most texts' prefixes hold nothing that could have an equal; the
others follow by how many texts have them.
The first shingle that two sets share has none of the others before it: what stands from there on in the smaller rest
bounds what they have in common, and a pair that the bound rules out at a shingle is no candidate there.

Scale: the shingles' hashes are shuffled once, by hash, to know how many texts have them. The order
only decides how many candidates there are, never which pairs are found. Where groups
of texts with a common shingle would give too many pairs, each text is first compared with one leader of its group, then
with a few, and so on in rounds, and only pairs whose texts no link joins yet are left. The sets of texts that are compared are stored once, and
read from where they stand: pairs are shuffled, sets aren't. A last join still looks at all pairs of a group's parts, if
only to rule them out; its rows grow with the square of a group only where texts share rare shingles early in the order
and yet aren't similar.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, SPACE, Texts, U, giving_back, grouped, mixed, pair_hash, ragged, xxh64
from .language_model import FILE, FILE_BITS, MOST_BITS, ROW, WORDS
from .language_model import _batches as row_batches
from .language_model import _by_shard as by_shard
from .language_model import _distinct as distinct
from .language_model import _Files as Files
from .language_model import _joined as joined_bytes
from .language_model import _mapped as mapped
from .language_model import _shard as shard_of
from .language_model import _slices as slices
from .row_keys import KEY, keyed
from .shared import file_system, materialize, shared_path
from .simhash import components, fingerprint_table, near_links

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers.
NUM, DEN = 4, 5
#: One shingle of so many is counted for the order: all, as only known ones can stand first. Text bytes of a shard, times
#: that; hashes that a task counts before it sends them.
SAMPLE, SHARD_BYTES, FLUSH = 1, 5 << 20, 600_000
#: A task's count of a shingle is sent as this at most: the order need not be exact, only the same for all texts.
MOST = 255
#: Pairs for each text that are compared without looking for leaders first; rounds of leaders; in each of these a group has so
#: many times the leaders of the round before, one in the first.
PAIRS, ROUNDS, LEADERS = 4, 5, 4
#: Files that a worker holds open, and sets that it keeps.
OPEN, READ = 256, 64


def shingle_sets(group: Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles, one text after the other, and the bounds of each text's.

    Words are runs of non-space bytes after lower-casing A-Z. A text of fewer words is one shingle, also one without any.
    """
    start, end, bounds = group.words(~SPACE)
    word = xxh64(LOWER[group.buf], start, end) if len(start) else np.zeros(0, U)
    n = np.diff(bounds)
    count = np.where(n >= shingle, n - shingle + 1, 1)
    first, size = ragged(bounds[:-1], count), np.repeat(np.minimum(n, shingle), count)
    h = mixed(size.astype(U))
    for k in range(shingle):
        on = size > k
        h[on] = pair_hash(h[on], word[first[on] + k])
    owner = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def prefixes(h: np.ndarray, bounds: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in h of the shingles in each set's prefix, in the order of `late`, then of the hash, and how many stand before
    each one in its set."""
    n = np.diff(bounds)
    order = np.lexsort((h, late, np.repeat(np.arange(len(n)), n)))
    size = n - -(-NUM * n // DEN) + 1
    return order[ragged(bounds[:-1], size)], ragged(np.zeros_like(size), size)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two sorted sets."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DEN * common >= NUM * (len(both) - common)


class _Counted:
    """Of one shingle in `every`, by hash, how many texts have it: sorted arrays of those that several have, with the bits of
    the number's length, in files of the shared folder, which workers memory-map."""

    def __init__(self, rows: DataFrame, every: int):
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.every, self.bits = every, min(MOST_BITS, max(2, int(np.ceil(np.log2(max(1, size / (SHARD_BYTES * every)))))))
        self.folder, self.shift = shared_path(rows.sparkSession, "shingles"), max(0, self.bits - FILE_BITS)
        folder, bits, shift, counted = self.folder, self.bits, self.shift, self.counted

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            held, n = [], 0
            for b in batches:
                for g in grouped(b.column(0)):
                    h = shingle_sets(g)[0]
                    held.append(h[counted(h)])
                    n += len(held[-1])
                    if n >= FLUSH:
                        yield np.concatenate(held)
                        held, n = [], 0
            if held:
                yield np.concatenate(held)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches):
                h, n = np.unique(chunk, return_counts=True)  # sets: each text counts once
                yield from row_batches((s, WORDS, h[k], np.minimum(n[k], MOST).astype(np.uint8)) for s, k in slices(shard_of(h, bits)))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = Files(folder, shift)

            def found() -> Iterator[tuple]:
                for shard, held in by_shard(batches):
                    h, n = joined_bytes(held[WORDS], 0, "<u8"), joined_bytes(held[WORDS], 1, "u1")
                    order, edge = distinct(h)
                    n = np.add.reduceat(n[order].astype(np.int64), edge)
                    yield from files.turn(shard, "key", "length")
                    files.append(key=h[order[edge]][n > 1], length=np.frexp(n[n > 1])[1].astype(np.uint8))
                yield from files.close()

            return row_batches(found())

        dealt = rows.select("text").mapInArrow(giving_back(count), ROW).repartitionById(1 << (bits - shift), F.shiftright("shard", shift)).sortWithinPartitions("shard")
        got = materialize(dealt.mapInArrow(giving_back(merge), ROW), "counted").where(F.col("kind") == FILE).select("shard", "a").collect()
        self.names = {r["shard"]: bytes(r["a"]).decode() for r in got}  # at most 2**FILE_BITS

    def counted(self, h: np.ndarray) -> np.ndarray:
        return h % U(self.every) == 0

    def late(self, h: np.ndarray, file) -> np.ndarray:
        """The order of shingles: 0 for those that one text has, 1 for uncounted ones, from 2 on the bits of the number of
        texts."""
        own = np.flatnonzero(self.counted(h))
        out = np.ones(len(h), np.uint8)
        name, back = np.unique(h[own], return_inverse=True)
        length = np.zeros(len(name), np.uint8)
        for part, k in slices(shard_of(name, self.bits - self.shift)):
            stored = file(self.names[part], "key", "<u8") if part in self.names else name[:0]
            if len(stored):
                at = np.minimum(np.searchsorted(stored, name[k]), len(stored) - 1)
                length[k] = np.where(stored[at] == name[k], file(self.names[part], "length", "u1")[at], 0)
        out[own] = length[back]
        return out


def _shared(rows: DataFrame, every: int) -> DataFrame:
    """(h, key, n, rest): the prefix shingles that more than one text has, with the size of the text's set and how much of it
    stands from there on."""
    sent = rows.sparkSession.sparkContext.broadcast(_Counted(rows, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        file = lru_cache(None)(lambda name, column, kind: mapped(counts.folder, f"{name}.{column}", kind))
        for b in batches:
            key = b.column(0).to_numpy()
            for g in grouped(b.column(1)):
                h, bounds = shingle_sets(g)
                late, n = counts.late(h, file), np.diff(bounds)
                at, before = prefixes(h, bounds, late)
                at, before = at[late[at] > 0], before[late[at] > 0]  # the others have no equal
                owner = np.searchsorted(bounds, at, "right") - 1
                columns = [h[at].view(np.int64), key[g.first + owner], n[owner].astype(np.int32), (n[owner] - before).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "key", "n", "rest"])

    entries = materialize(rows.select(KEY, "text").mapInArrow(giving_back(run), "h long, key long, n int, rest int"), "prefixes")
    often = entries.groupBy("h").count().where(F.col("count") > 1).select("h")
    return materialize(entries.join(often, "h"), "shared")


class _Sets:
    """Texts' sets of shingles in files of the shared folder, and where each one stands: (key, file, at, size)."""

    def __init__(self, rows: DataFrame):
        self.rows, self.folder, self.places = rows, shared_path(rows.sparkSession, "sets"), None

    def add(self, nodes: DataFrame) -> None:
        """Stores the sets of (key) that aren't stored yet."""
        folder = self.folder
        nodes = nodes if self.places is None else nodes.join(self.places, "key", "left_anti")
        nodes = materialize(nodes, "nodes")  # its size, as written, tells Spark whether it can be broadcast
        wanted = self.rows.select(F.col(KEY).alias("key"), "text").join(nodes, "key", "left_semi")

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = file_system(folder)
            fs.create_dir(base, recursive=True)
            name, at = uuid.uuid4().hex, 0  # in no other attempt's way
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                for b in batches:
                    for g in grouped(b.column(1)):
                        h, bounds = shingle_sets(g)
                        out.write(h.astype("<u8").tobytes())
                        arrays = [b.column(0)[g.first : g.first + g.n], pa.array([name] * g.n, pa.string()), pa.array(bounds[:-1] + at), pa.array(np.diff(bounds))]
                        yield pa.RecordBatch.from_arrays(arrays, ["key", "file", "at", "size"])
                        at += len(h)

        places = materialize(wanted.mapInArrow(giving_back(store), "key long, file string, at long, size long"), "places")
        self.places = places if self.places is None else self.places.unionByName(places)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) of stored keys whose texts are similar."""
        folder = self.folder
        for side in ("v", "u"):
            pairs = pairs.join(self.places.select(F.col("key").alias(side), F.struct("file", "at", "size").alias(f"_{side}")), side)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = file_system(folder)
            open_file = lru_cache(OPEN)(lambda name: fs.open_input_file(f"{base}/{name}"))
            read = lru_cache(READ)(lambda name, at, size: np.frombuffer(open_file(name).read_at(8 * size, 8 * at), U))
            for b in batches:
                a, c = ([tuple(x.values()) for x in b.column(k).to_pylist()] for k in (2, 3))
                keep = [similar(read(*x), read(*y)) for x, y in zip(a, c, strict=True)]
                yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return pairs.select("u", "v", "_u", "_v").sortWithinPartitions("u").mapInArrow(giving_back(compare), "u long, v long")


def _fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of keys whose fingerprints over words of SHINGLE are equal or linked by the trie's join: a forest."""
    fp = materialize(fingerprint_table(rows, KEY, "text", SHINGLE).withColumnRenamed("doc_id", "key"), "fingerprints")
    fps = materialize(fp.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    links = near_links(fps.select("fp"))
    for side in ("u", "v"):
        links = links.join(fps.select(F.col("fp").alias(side), F.col("least").alias(f"_{side}")), side)
    links = links.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
    equal = fp.join(fps, "fp").where("key > least").select(F.col("least").alias("u"), F.col("key").alias("v"))
    return materialize(links.unionByName(equal).distinct(), "pairs")


def _labels(links: DataFrame, before: DataFrame | None) -> DataFrame:
    """(key, part) of keys, from the labels before and all links (u, v) so far: equal parts only within a component,
    though a component may still have several. Each part takes the least of those it is linked with, then that one's,
    three times; there are no rounds until nothing changes, but links that still join parts count again the next time."""
    if before is not None:
        for side in ("u", "v"):
            links = links.join(before.select(F.col("key").alias(side), F.col("part").alias(f"_{side}")), side, "left")
        links = links.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")).where("u <> v")
    least = F.least("u", "v").alias("part")
    both = links.select(F.col("u").alias("key"), least).unionByName(links.select(F.col("v").alias("key"), least))
    labels = both.groupBy("key").agg(F.min("part").alias("part"))
    for _ in range(3):
        labels = materialize(labels, "labels")
        ahead = labels.where("key <> part").select(F.col("key").alias("part"), F.col("part").alias("ahead"))
        labels = labels.join(ahead, "part", "left").select("key", F.coalesce("ahead", "part").alias("part"))
    labels = materialize(labels, "labels")
    if before is None:
        return labels
    moved = before.join(labels.select(F.col("key").alias("part"), F.col("part").alias("ahead")), "part", "left").select("key", F.coalesce("ahead", "part").alias("part"))
    return materialize(moved.unionByName(labels.join(before, "key", "left_anti")), "labels")


def similar_links(rows: DataFrame, pairs_a_text: int = PAIRS, rounds: int = ROUNDS) -> DataFrame:
    """Links (u, v) of the keys of rows (KEY, text): their components are those of all pairs that are similar."""
    shared, most, sets = _shared(rows, SAMPLE), pairs_a_text * rows.count(), _Sets(rows)
    pairs = tried = _fingerprint_pairs(rows)
    links = labels = None
    for k in range(rounds + 2):
        sets.add(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct())
        found = materialize(sets.verified(pairs), "similar")
        links = found if links is None else links.unionByName(found)
        if k and last:
            return links
        labels = _labels(links, labels)
        now = shared.join(labels, "key", "left").withColumn("part", F.coalesce("part", "key"))
        open_groups = now.groupBy("h").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("h")
        now = materialize(now.join(open_groups, "h"), "open")
        sizes = now.groupBy("h", "part").count().groupBy("h").agg(F.sum(F.col("count").cast("double")).alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("own"))
        last = k == rounds or (sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0) <= most
        a = now.select("h", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("rest").alias("rx"), F.col("part").alias("px"))
        if not last:
            leader = F.min(F.struct(F.xxhash64("x", "h", F.lit(k)).alias("by"), "x", "nx", "rx", "px")).alias("s")
            some = F.pmod(F.xxhash64("x", F.lit(k)), F.lit(LEADERS**k))
            a = a.groupBy("h", some).agg(leader).select("h", "s.x", "s.nx", "s.rx", "s.px")
        both = now.join(a, "h").where(F.col("part") != F.col("px"))
        # Similar sets of n and nx have NUM / (NUM + DEN) of n + nx in common, all in the rests at the first shingle they share.
        both = both.where((NUM + DEN) * F.least("rest", "rx") >= NUM * (F.col("n") + F.col("nx")))
        pairs = both.select(F.least("key", "x").alias("u"), F.greatest("key", "x").alias("v")).distinct()
        pairs = materialize(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
    raise AssertionError("the last round returns")


def without_similar(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of texts that similar pairs join, the one with the least doc_id.

    Null counts as empty, and all texts without words are alike; repeated rows are alike. An empty table gives an empty
    result.
    """
    rows = keyed(docs)
    texts = rows.select(KEY, F.col("text").cast("string").alias("text"))
    dropped = components(similar_links(texts)).where("node <> component").select(F.col("node").alias(KEY))
    return rows.join(dropped, KEY, "left_anti").select(*docs.columns)
