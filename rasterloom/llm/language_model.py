"""LM scoring: an interpolated modified Kneser-Ney n-gram model of any order, counted in Spark.

Tokens are 64-bit hashes of lower-cased words, and one end token a text; a text's first tokens have
contexts of begin marks. Tasks count the n-grams of their own texts first and send sorted arrays of distinct
ones, dealt by ranges of hashes (shards). Each shard's arrays are merged and written to the shared folder as
sorted hash arrays; what follows each context, and how many tokens stand before each shorter n-gram, goes on
to the shards of the next lower order, down to single words. Nothing is pruned. Workers memory-map the arrays
to score; probabilities are put together while scoring, with discounts from counts of counts at each order.

A key's first bits are those of its context, so a context's n-grams stand in one shard; n-grams behind a word
with more than its share of all tokens are dealt by their own hash instead, so none holds a frequent word's
n-grams alone.

Scale: what is sent is at most one entry per distinct n-gram and task, what a task holds is bounded by bytes,
and shards grow in number with the input (to 2**20, at SHARD_BYTES of text each; beyond that in size). They are
written one behind the other into at most 2**FILE_BITS files of an order, each sorted as a whole: a batch of
lookups is one search a file, however many shards there are. The driver keeps these files' names, at most
MOST_HOT frequent words and a few sums. A batch reads pages at random places of the files, so the shared folder
should be mounted on the workers; a file in another store is fetched whole by each worker that needs it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import LOWER, SPACE, Texts, U, byte_spans, giving_back, grouped, pair_hash, span_hash, sums
from .shared import file_system, materialize, shared_path

BEGIN, END = U(0x5BD1E995C2B2AE35), U(0x27D4EB2F9E3779B1)
ORDER = 2
#: Text bytes of a shard, tokens that a task counts before it sends them, bytes of text scored at once.
SHARD_BYTES, FLUSH_TOKENS, SCORE_BYTES = 4 << 20, 600_000, 2 << 20
#: Shards grow in number with the input up to 2**MOST_BITS, the first bits of a key. Files of an order: 2**FILE_BITS.
MOST_BITS, FILE_BITS, MOST_HOT = 20, 9, 1 << 16
TOP = U(((1 << MOST_BITS) - 1) << (64 - MOST_BITS))
WORD = np.dtype([("count", "<i8"), ("before", "<i8"), ("total", "<i8"), ("one", "<i8"), ("two", "<i8"), ("more", "<i8")])
CONTEXT = np.dtype([("total", "<i8"), ("one", "<i8"), ("two", "<i8"), ("more", "<i8")])
LARGE = np.dtype([("at", "<i8"), ("count", "<i8")])


def tokens(group: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the group's texts, each with its end token, and the bounds of each text's."""
    buf = LOWER[group.buf]
    start, end, bounds = group.words(~SPACE, buf)
    h = span_hash(buf, start, end)
    n = np.diff(bounds)
    out = np.full(len(h) + len(n), END, U)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, np.concatenate([[0], np.cumsum(n + 1)])


def chains(token: np.ndarray, first: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each token, the names of the 1, 2, ..., order - 1 tokens before it, and of the 1, 2, ..., order up to it.
    Texts start at `first`; before them stand BEGIN marks. A name of k + 1 tokens is made of those of the k before and the
    k up to its last."""
    contexts, grams, begin = [], [token], np.array([BEGIN])
    for _ in range(order - 1):
        before = np.concatenate([begin, grams[-1][:-1]])
        before[first] = begin[0]
        contexts.append(before)
        grams.append(pair_hash(before, grams[-1]))
        begin = pair_hash(begin, begin)
    return contexts, grams


def keys_of(contexts: list[np.ndarray], gram: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The keys of n-grams under which they are stored: the context's first bits, but those of its own name behind a
    frequent word; and the last bits of its name."""
    last = contexts[0]
    frequent = hot[np.minimum(np.searchsorted(hot, last), len(hot) - 1)] == last
    return np.where(frequent, gram, (contexts[-1] & TOP) | (gram & ~TOP))


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _slices(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    if not len(shard):
        return
    edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for i, j in zip(edge.tolist(), np.append(edge[1:], len(shard)).tolist(), strict=True):
        yield int(shard[i]), slice(i, j)


ROW = "shard int, kind int, a binary, b binary, c binary, d binary"
#: Kinds of rows: word counts, n-grams, contexts, contexts of words, words before a word; the name of a file and sums over it.
WORDS, GRAMS, CONTEXTS, FOLLOWED, BEFORE, FILE = range(6)
SEND_BYTES = 4 << 20


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """(shard, kind, arrays...) as batches of bounded size."""
    held, size = [], 0
    for shard, kind, *arrays in rows:
        held.append((shard, kind, *(np.ascontiguousarray(x).tobytes() for x in arrays), *[b""] * (4 - len(arrays))))
        size += sum(map(len, held[-1][2:]))
        if size > SEND_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "kind", *"abcd"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """Rows (sorted by shard) gathered shard by shard: for each kind a list of its rows' columns, copied out of the batch."""
    now, held = None, {}
    for b in batches:
        shards, kinds = b.column(0).to_pylist(), b.column(1).to_pylist()
        spans = [byte_spans(b.column(k)) for k in range(2, 6)]
        for k, (shard, kind) in enumerate(zip(shards, kinds, strict=True)):
            if shard != now:
                if held:
                    yield now, held
                now, held = shard, {}
            held.setdefault(kind, []).append(tuple(data[start[k] : end[k]].tobytes() for data, start, end in spans))
    if held:
        yield now, held


def _joined(rows: list[tuple], column: int, kind: str | np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts key, and where in it each distinct key starts."""
    order = np.argsort(key)
    s = key[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, and the sums of each one's values."""
    order, edge = _distinct(key)
    return key[order[edge]], *(np.add.reduceat(v[order], edge, axis=0, dtype=np.int64) if len(edge) else v for v in values)


def _token_chunks(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens, and where texts start among them, in chunks of about `flush` tokens."""
    held, n = [], 0
    for b in batches:
        for g in grouped(b.column(0)):
            token, bounds = tokens(g)
            held.append((token, bounds[:-1] + n))
            n += len(token)
            if n >= flush:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


class _Files:
    """Sorted arrays of successive shards, appended to the columns of a file; each part of the shards has one."""

    def __init__(self, folder: str, shift: int):
        self.fs, self.base = file_system(folder)
        self.shift, self.part, self.stack = shift, None, ExitStack()

    def turn(self, shard: int, *columns: str) -> Iterator[tuple]:
        """Opens the file of the shard, if another one was open."""
        if self.part != shard >> self.shift:
            yield from self.close()
            self.fs.create_dir(self.base, recursive=True)
            self.part, self.name, self.rows, self.told = shard >> self.shift, uuid.uuid4().hex, 0, np.zeros(6, np.int64)
            self.streams = {c: self.stack.enter_context(self.fs.open_output_stream(f"{self.base}/{self.name}.{c}", compression=None)) for c in columns}

    def append(self, told: np.ndarray | None = None, **columns: np.ndarray) -> None:
        for c, x in columns.items():
            self.streams[c].write(np.ascontiguousarray(x).tobytes())
        self.rows += len(columns["key"])
        if told is not None:
            self.told += told

    def close(self) -> Iterator[tuple]:
        """The row that tells the file's name (in no other attempt's folder) and what was counted."""
        if self.part is not None:
            self.stack.close()
            yield self.part, FILE, np.frombuffer(self.name.encode(), np.uint8), self.told
            self.part = None


@dataclass
class Counts:
    """What the driver keeps of the training texts."""

    folder: str
    order: int
    bits: int
    shift: int  # a part is a shard without so many last bits
    hot: np.ndarray
    tokens: int = 0
    vocabulary: int = 0
    distinct: dict[int, int] = field(default_factory=dict)  # by order: distinct n-grams
    of_count: dict[int, list[int]] = field(default_factory=dict)  # by order: [n] of count n; [5] of count 3 or more
    names: dict[str, dict[int, str]] = field(default_factory=dict)  # grams2, contexts2, words, ...: files by part

    def add(self, what: str, order: int, rows: DataFrame) -> None:
        """Takes the files that rows name, at most 2**FILE_BITS, as those of `what`."""
        got = rows.where(F.col("kind") == FILE).select("shard", "a", "b").collect()
        self.names[what] = {r["shard"]: bytes(r["a"]).decode() for r in got}
        told = sum((np.frombuffer(r["b"], "<i8") for r in got), np.zeros(6, np.int64))
        if order:
            self.distinct[order], self.of_count[order] = int(told[0]), [0, *map(int, told[1:])]


def discounts(n: list[int]) -> np.ndarray:
    """D(1), D(2), D(3+) of modified Kneser-Ney from counts of counts; each at least 0.05 and below its count."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y for k in (1, 2, 3)]
    return np.array([min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)])


def _told(count: np.ndarray) -> np.ndarray:
    return np.array([(count > 0).sum(), *((count == k).sum() for k in (1, 2, 3, 4)), (count >= 3).sum()], np.int64)


def _gram_rows(contexts: list[np.ndarray], token: np.ndarray, gram: np.ndarray, count: np.ndarray, key: np.ndarray, bits: int) -> Iterator[tuple]:
    """Distinct n-grams as rows of their shards: the contexts (each once, with the number of its n-grams), the shorter
    contexts and the tokens, and the counts."""
    order = np.argsort((key & TOP) | (contexts[-1] & ~TOP))
    long, count = contexts[-1][order], count[order]
    rest = [x[order] for x in (*contexts[:-1], token)]
    for s, k in _slices(_shard(key[order], bits)):
        edge = np.flatnonzero(np.concatenate([[True], long[k][1:] != long[k][:-1]]))
        follow = np.diff(np.append(edge, k.stop - k.start)).astype("<u4")
        yield s, GRAMS, long[k][edge], follow, np.concatenate([x[k] for x in rest]), count[k].astype("<u4")


def train(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Counts:
    """Counts the n-grams of the texts of docs, up to `order` tokens."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(2, int(np.ceil(np.log2(max(1, size / shard_bytes))))))
    model = Counts(shared_path(spark, "ngrams"), order, bits, max(0, bits - FILE_BITS), np.array([BEGIN]))
    flush = FLUSH_TOKENS

    def dealt(df: DataFrame) -> DataFrame:
        part = F.shiftright("shard", model.shift)
        return df.repartitionById(1 << (bits - model.shift), part).sortWithinPartitions("shard")

    def count_words(batches):
        for token, _ in _token_chunks(batches, flush):
            word, count = _summed(token, np.ones(len(token), np.int64))
            yield from _batches((s, WORDS, word[k], count[k]) for s, k in _slices(_shard(word, bits)))

    def merge_words(batches):
        for shard, held in _by_shard(batches):
            yield from _batches([(shard, WORDS, *_summed(_joined(held[WORDS], 0, "<u8"), _joined(held[WORDS], 1, "<i8")))])

    words = materialize(dealt(texts.mapInArrow(giving_back(count_words), ROW)).mapInArrow(giving_back(merge_words), ROW), "words")

    def sizes(batches):
        for _, held in _by_shard(batches):
            count = _joined(held[WORDS], 1, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([len(count)]), pa.array([int(count.sum())])], ["n", "total"])

    found = words.mapInArrow(sizes, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    model.vocabulary, model.tokens = (int(x or 0) for x in found)
    # Words with more tokens than a quarter of a shard's share, and BEGIN; fewer than MOST_HOT.
    share = max(model.tokens / min(4 << bits, MOST_HOT), 1)

    def frequent(batches):
        for _, held in _by_shard(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_joined(held[WORDS], 0, "<u8")[_joined(held[WORDS], 1, "<i8") > share].view(np.int64))], ["word"])

    hot = np.array([r[0] for r in words.mapInArrow(frequent, "word long").collect()], np.int64).view(U)
    model.hot = np.sort(np.append(hot, BEGIN))

    def count_grams(batches):
        for token, first in _token_chunks(batches, flush):
            contexts, grams = chains(token, first, order)
            gram = grams[-1]
            del grams
            key = keys_of(contexts, gram, model.hot)
            by, edge = _distinct(key)
            count = np.diff(np.append(edge, len(by)))
            at = by[edge]
            yield from _batches(_gram_rows([x[at] for x in contexts], token[at], gram[at], count, key[at], bits))

    def merging(n: int):
        """Of n-grams of n tokens."""

        def rows(batches):
            files = _Files(model.folder, model.shift)
            for shard, held in _by_shard(batches):
                own = held[GRAMS]
                follow, count = _joined(own, 1, "<u4"), _joined(own, 3, "<u4")
                long = np.repeat(_joined(own, 0, "<u8"), follow)
                # Each row's shorter contexts and tokens stand one array behind the other.
                rest = [np.frombuffer(b"".join(r[2][len(r[2]) // (n - 1) * k : len(r[2]) // (n - 1) * (k + 1)] for r in own), "<u8") for k in range(n - 1)]
                held.clear()
                own.clear()
                contexts, token = [*rest[:-1], long], rest[-1]
                gram = token
                for x in contexts:
                    gram = pair_hash(x, gram)
                key = keys_of(contexts, gram, model.hot)
                by, edge = _distinct(key)
                count, at = np.add.reduceat(count[by], edge, dtype=np.int64), by[edge]
                key, contexts, token = key[at], [x[at] for x in contexts], token[at]
                del by, edge, gram, long, rest
                yield from files.turn(shard, "key", "count", "large")
                at = np.flatnonzero(count >= 255)
                large = np.zeros(len(at), LARGE)
                large["at"], large["count"] = at + files.rows, count[at]
                files.append(_told(count), key=key, count=np.minimum(count, 255).astype(np.uint8), large=large)
                # What follows each context, to the contexts' shards.
                by, edge = _distinct(contexts[-1])
                context, c = contexts[-1][by[edge]], count[by]
                value = np.zeros(len(edge), CONTEXT)
                value["total"] = np.add.reduceat(c, edge)
                for f, hit in (("one", c == 1), ("two", c == 2), ("more", c >= 3)):
                    value[f] = np.add.reduceat(hit, edge, dtype=np.int64)
                for s, k in _slices(_shard(context, bits)):
                    yield s, FOLLOWED if n == 2 else CONTEXTS, context[k], value[k]
                # The shorter n-grams, by how many tokens stand before each.
                if n == 2:
                    word, before = _summed(token, np.ones(len(token), np.int64))
                    for s, k in _slices(_shard(word, bits)):
                        yield s, BEFORE, word[k], before[k]
                else:
                    shorter = contexts[:-1]
                    gram = token
                    for x in shorter:
                        gram = pair_hash(x, gram)
                    key = keys_of(shorter, gram, model.hot)
                    by, edge = _distinct(key)
                    at = by[edge]
                    yield from _gram_rows([x[at] for x in shorter], token[at], gram[at], np.diff(np.append(edge, len(by))), key[at], bits)
            yield from files.close()

        return giving_back(lambda batches: _batches(rows(batches)))

    def merge_contexts(batches):
        files = _Files(model.folder, model.shift)

        def rows():
            for shard, held in _by_shard(batches):
                value = _joined(held[CONTEXTS], 1, "<i8").reshape(-1, 4)
                key, value = _summed(_joined(held[CONTEXTS], 0, "<u8"), value)
                yield from files.turn(shard, "key", "value")
                files.append(key=key, value=value)
            yield from files.close()

        return _batches(rows())

    level = texts.mapInArrow(giving_back(count_grams), ROW)
    for n in range(order, 1, -1):
        level = materialize(dealt(level).mapInArrow(merging(n), ROW), f"grams{n}")
        model.add(f"grams{n}", n, level)
        if n > 2:
            stored = materialize(dealt(level.where(F.col("kind") == CONTEXTS)).mapInArrow(giving_back(merge_contexts), ROW), "contexts")
            model.add(f"contexts{n - 1}", 0, stored)
            level = level.where(F.col("kind") == GRAMS)

    def merge_fields(batches):
        files = _Files(model.folder, model.shift)

        def rows():
            for shard, held in _by_shard(batches):
                words = [_joined(held.get(kind, []), 0, "<u8") for kind in (WORDS, BEFORE, FOLLOWED)]
                value = np.zeros((sum(map(len, words)), 6), np.int64)
                i, j = len(words[0]), len(words[0]) + len(words[1])
                value[:i, 0] = _joined(held.get(WORDS, []), 1, "<i8")
                value[i:j, 1] = _joined(held.get(BEFORE, []), 1, "<i8")
                value[j:, 2:] = _joined(held.get(FOLLOWED, []), 1, "<i8").reshape(-1, 4)
                key, value = _summed(np.concatenate(words), value)
                yield from files.turn(shard, "key", "value")
                files.append(_told(value[:, 1]), key=key, value=value)
            yield from files.close()

        return _batches(rows())

    fields = level.where(F.col("kind").isin(FOLLOWED, BEFORE)).unionByName(words)
    model.add("words", 1, materialize(dealt(fields).mapInArrow(giving_back(merge_fields), ROW), "fields"))
    return model


def _mapped(folder: str, name: str, kind: str | np.dtype) -> np.ndarray:
    """The file's array, memory-mapped. One that isn't on a mounted file system is fetched first, to a file that goes
    with the mapping."""
    from pyarrow import fs as pafs

    fs, base = file_system(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        source = f"{base}/{name}"
        return np.memmap(source, kind, "r") if fs.get_file_info(source).size else np.zeros(0, kind)
    with tempfile.TemporaryFile() as local:
        with fs.open_input_stream(f"{base}/{name}") as source:
            while part := source.read(1 << 22):
                local.write(part)
        local.flush()
        return np.memmap(local, kind, "r") if local.tell() else np.zeros(0, kind)


class Scorer:
    """Looks n-grams up in the mapped arrays, and gives log10 probabilities."""

    def __init__(self, counts: Counts):
        self.c = counts
        self.file = lru_cache(None)(self._file)
        self.d = {n: discounts(x) for n, x in counts.of_count.items()}
        n = counts.of_count[1]
        pairs = counts.distinct[2]
        self.left = float(self.d[1] @ [n[1], n[2], n[5]]) / pairs if pairs else 1.0

    def _file(self, what: str, part: int, column: str, kind: str | np.dtype) -> np.ndarray | None:
        """A column of the file of a part of the shards, mapped when it is first looked up."""
        name = self.c.names[what].get(part)
        return None if name is None else _mapped(self.c.folder, f"{name}.{column}", kind)

    def _found(self, what: str, key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For sorted keys, file by file: the part, which keys it has, and where."""
        for part, k in _slices(_shard(key, self.c.bits - self.c.shift)):
            stored = self.file(what, part, "key", "<u8")
            if stored is not None and len(stored):
                at = np.minimum(np.searchsorted(stored, key[k]), len(stored) - 1)
                hit = np.flatnonzero(stored[at] == key[k])
                yield part, k.start + hit, at[hit]

    def values(self, what: str, key: np.ndarray, kind: np.dtype) -> np.ndarray:
        """The numbers stored for each of the sorted keys; zeros for unknown ones."""
        out = np.zeros((len(key), len(kind)), np.int64)
        for part, own, at in self._found(what, key):
            out[own] = self.file(what, part, "value", kind)[at].view("<i8").reshape(-1, len(kind))
        return out

    def counts(self, n: int, key: np.ndarray) -> np.ndarray:
        """The counts of the n-grams under sorted keys."""
        out = np.zeros(len(key), np.int64)
        for part, own, at in self._found(f"grams{n}", key):
            got = self.file(f"grams{n}", part, "count", "u1")[at].astype(np.int64)
            top = np.flatnonzero(got == 255)
            if len(top):
                large = self.file(f"grams{n}", part, "large", LARGE)
                got[top] = large["count"][np.searchsorted(large["at"], at[top])]
            out[own] = got
        return out

    @staticmethod
    def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.maximum(count - d[np.clip(count, 1, 3) - 1], 0) * (count > 0)

    def score(self, token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, base score, model score."""
        c = self.c
        contexts, grams = chains(token, bounds[:-1], c.order)
        names, at = np.unique(np.append(token, BEGIN), return_inverse=True)
        begin, at = at[-1], at[:-1]
        fields = self.values("words", names, WORD)
        count = fields[:, 0]
        base = np.log10((count + 0.5) / (c.tokens + 0.5 * (c.vocabulary + 1)))
        p = (self.discounted(fields[:, 1], self.d[1]) / max(c.distinct[2], 1) + self.left / (c.vocabulary + 1))[at]
        for n in range(2, c.order + 1):
            key, back = np.unique(keys_of(contexts[: n - 1], grams[n - 1], c.hot), return_inverse=True)
            own = self.discounted(self.counts(n, key), self.d[n])[back]
            if n == 2:
                before = np.concatenate([[begin], at[:-1]])
                before[bounds[:-1]] = begin
                follow = fields[:, 2:]
            else:
                names, before = np.unique(contexts[n - 2], return_inverse=True)
                follow = self.values(f"contexts{n - 1}", names, CONTEXT)
            total = follow[:, 0]
            left = np.where(total > 0, follow[:, 1:] @ self.d[n] / np.maximum(total, 1), 1.0)
            p = own / np.maximum(total, 1)[before] + left[before] * p
        return sums(count[at] > 0, bounds), sums(base[at], bounds), sums(np.log10(p), bounds)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def lm_scores(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns n-grams of up to `order` tokens from texts whose crc32(doc_id) mod 5 isn't 1. A null, empty or blank text is
    one end token; a null doc_id is learned from; repeated rows and ties count each time. Without any text to learn from,
    every token has probability 1. Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(texts.where(~held_out()), order, shard_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            for g in grouped(b.column(1), SCORE_BYTES):
                token, bounds = tokens(g)
                known, base, score = scorer.score(token, bounds)
                arrays = [b.column(0)[g.first : g.first + g.n], pa.array(np.diff(bounds)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    scored = texts.mapInArrow(giving_back(run), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
