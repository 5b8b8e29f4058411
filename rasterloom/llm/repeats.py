"""Removal of repeated passages: every byte that a LENGTH-byte string covers which also starts earlier.

Shipping a corpus's suffixes to sort them costs LENGTH times the text, so only strings that can have
an equal are compared, and how they are grouped never depends on where they stand:

1. In every window of LENGTH bytes the ANCHOR-byte string with the least hash is its anchor (leftmost
   among equals). Equal windows have equal anchors at equal places. Neighbouring windows with one
   anchor make a block; blocks, about one in 39 bytes, are sent as hashes, grouped by anchor.
2. Blocks equal as a whole: all but the first are removed. First ones whose anchor occurs in no other
   block can have no repeat and are done.
3. The rest, the edges of repeats, are sent with their bytes, dealt by anchor into shards. For each
   shard a suffix array is built by Larsson-Sadakane refinement (ranks of h bytes give ranks of 2h;
   only groups of equal rank are sorted again; it stops beyond LENGTH), and Kasai's walk gives common
   prefixes. Neighbours in the array that share LENGTH bytes are equal windows; all but the first go.
4. An anchor that is frequent within one task (a passage that very many texts share) isn't dealt by
   anchor: its blocks are dealt by content, and its windows are sorted by each task, cut by binary
   search at fixed hash ranges, and merged across tasks range by range.

Equal means, for whole blocks, one hash of the bytes (64 bits) and of the anchor in them (64 bits); for windows of frequent
anchors, hashes of both halves (64 bits each); in the arrays, equal bytes.

Scale: tasks keep the first of equal blocks or windows before anything is sent, so a group of copies
sends a row a task; whole texts are shuffled once, by document. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import BYTE_VALUE, Texts, U, as_bytes, byte_spans, giving_back, grouped, mixed, powers, prefix_hash, ragged, span_hash
from .shared import materialize

LENGTH, ANCHOR = 100, 24
#: Text bytes of a shard, blocks that a task gathers before it sends them, blocks of one anchor in a task that make it
#: frequent, bytes of a suffix array.
SHARD_BYTES, FLUSH_BLOCKS, FREQUENT, ARRAY_BYTES = 8 << 20, 500_000, 64, 2 << 20
#: Shards grow in number with the input up to 2**MOST_BITS; a partition takes several, one after the other, beyond MOST_PARTS.
MOST_BITS, MOST_PARTS = 20, 1 << 16
#: Of an anchor's hash all but so many bits decide, so that the choice is the same in a text of any length.
PLACE_BITS = 31
BLOCK, FREQUENT_BLOCK, MARK, REMOVED = range(4)
SCHEMA = "shard int, kind int, a binary, b binary, c binary, d binary, e binary"


# Suffix arrays


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text (values below 512) in the order of their first `depth` symbols at least."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(7, text.dtype)]).astype(U)
    key = np.zeros(n, U)
    for k in range(7):
        key = (key << U(9)) | wide[k : k + n]
    sa = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # beyond the end
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    slots = np.flatnonzero(~(first & np.append(first[1:], True)))
    h = 7
    while len(slots) and h < depth:
        # Groups of equal rank are sorted by the rank h further on; each group keeps its slots.
        at = sa[slots]
        key2 = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        order = np.argsort(key2, kind="stable")
        at, key2 = at[order], key2[order]
        sa[slots] = at
        first = np.concatenate([[True], key2[1:] != key2[:-1]])
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        slots = slots[~(first & np.append(first[1:], True))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, start: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Kasai: for the suffixes start[k] .. start[k] + count[k] - 1 of each string k, how many symbols (up to `most`) they
    share with the suffix before in sa. Zeros in text end strings. All strings advance together; from one suffix to
    the next a common prefix shrinks by one at most, if the former neighbour's next suffix stands before this one: as sa
    is in order of bounded prefixes only, it need not, and then the walk starts anew."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(most + 1, text.dtype)])
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    place = np.empty(n + 1, np.int64)
    place[sa], place[n] = np.arange(n), n
    out = np.zeros(n, np.int64)
    length = np.zeros(len(start), np.int64)
    last = np.full(len(start), n - 1)
    for step in range(int(count.max()) if len(count) else 0):
        own = np.flatnonzero(count > step)
        i = start[own] + step
        j = before[i]
        goes_on = (j >= 0) & (place[last[own] + 1] < place[i])
        length[own] = np.where(goes_on, np.maximum(length[own] - 1, 0), 0)
        last[own] = np.where(j < 0, n - 1, j)
        on = np.flatnonzero((j >= 0) & (length[own] < most))
        while len(on):
            k = length[own[on]]
            x = padded[i[on] + k]
            on = on[(x == padded[j[on] + k]) & (x != 0)]
            length[own[on]] += 1
            on = on[length[own[on]] < most]
        out[i] = length[own]
    return out


def repeated_windows(pieces: np.ndarray, count: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows that have an equal one earlier, among the windows of some strings.

    pieces: the strings' bytes one after the other; string k has count[k] windows, thus count[k] + length - 1 bytes,
    and stands in document doc[k] from at[k].
    """
    size = count + length - 1
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int16)
    text[ragged(begin, size)] = pieces.astype(np.int16) + 1
    sa = suffix_array(text, length)
    same = common_prefixes(text, sa, begin, count, length)[sa] >= length
    group = np.cumsum(~same)
    crowd = np.bincount(group)
    keep = crowd[group] > 1
    group, where = group[keep], sa[keep]
    k = np.searchsorted(begin, where, "right") - 1
    d, p = doc[k], at[k] + where - begin[k]
    return _later(d, p, group)


def _later(doc: np.ndarray, at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, at) of all but the first of each group of equal keys."""
    order = np.lexsort((at, doc, *keys))
    again = np.zeros(len(order), bool)
    if len(order):
        again[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    return doc[order][again], at[order][again]


def runs(doc: np.ndarray, at: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, at, count): windows at, at + 1, ..., joined where they meet or overlap."""
    if not len(doc):
        return doc, at, np.zeros(0, np.int64)
    count = np.ones(len(doc), np.int64) if count is None else count
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + count)[order]
    # The furthest end so far within the document: ends are shifted apart by document to take one running maximum.
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    shift = number * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | ((at + shift)[1:] > far[:-1])])
    edge = np.flatnonzero(new)
    last = np.append(edge[1:], len(doc)) - 1
    return doc[edge], at[edge], (far - shift)[last] - at[edge]


# Blocks


def blocks(group: Texts, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, text index in the group, first window, number of windows) of the group's blocks."""
    n, none = len(group.buf), np.zeros(0, np.int64)
    if n < length:
        return none.astype(U), none.astype(U), none, none, none
    if n >> PLACE_BITS:
        raise ValueError(f"a text of 2**{PLACE_BITS} bytes or more")
    prefix = prefix_hash(BYTE_VALUE[group.buf])
    h = mixed((prefix[anchor:] - prefix[:-anchor]) * powers(n + 1)[1][: n - anchor + 1])
    del prefix
    place = U((1 << PLACE_BITS) - 1)
    least = (h & ~place) | np.arange(len(h), dtype=U)
    wide, span = length - anchor + 1, 1
    end = len(least) - wide + 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    at = (np.minimum(least[:end], least[wide - span : wide - span + end]) & place).astype(np.int64)
    inside = np.zeros(end + 1, np.int64)
    whole = group.end - group.start >= length
    np.add.at(inside, group.start[whole], 1)
    np.add.at(inside, group.end[whole] - length + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]))
    count = np.append(edge[1:], end) - edge
    edge, count = edge[inside[edge]], count[inside[edge]]
    text = np.searchsorted(group.start, edge, "right") - 1
    # The least hashes are small numbers: mixed again, they are even over their range, as shards need.
    return mixed(h[at[edge]] + U(1)), span_hash(group.buf, edge, edge + count + length - 1), text, edge - group.start[text], count


def _row(shard: int, kind: int, *arrays: np.ndarray) -> tuple:
    return (shard, kind, *(np.ascontiguousarray(x).tobytes() for x in arrays), *[b""] * (5 - len(arrays)))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r[2:]))
        if size > 1 << 23:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "kind", *"abcde"])


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)


def _slices(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    if not len(key):
        return
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for i, j in zip(edge, np.append(edge[1:], len(key)), strict=True):
        yield int(key[i]), slice(i, j)


def _sent_blocks(anchor: np.ndarray, block: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray, bits: int, salt: int) -> Iterator[tuple]:
    """What a task sends of its blocks: the first of equal ones, and the others as removed."""
    order = np.lexsort((at, doc, block))
    anchor, block, doc, at, count = (x[order] for x in (anchor, block, doc, at, count))
    again = np.concatenate([[False], (block[1:] == block[:-1]) & (anchor[1:] == anchor[:-1])]) if len(block) else np.zeros(0, bool)
    if again.any():
        yield _row(salt % (1 << bits), REMOVED, *_removed(doc[again], at[again], count[again]))
    anchor, block, doc, at, count = (x[~again] for x in (anchor, block, doc, at, count))
    names, back, crowd = np.unique(anchor, return_inverse=True, return_counts=True)
    frequent = crowd[back] >= FREQUENT
    for s, k in _slices(_shard(names[crowd >= FREQUENT], bits)):
        yield _row(s, MARK, names[crowd >= FREQUENT][k])
    for kind, own, by in ((BLOCK, ~frequent, anchor), (FREQUENT_BLOCK, frequent, block)):
        own = np.flatnonzero(own)
        shard = _shard(by[own], bits)
        own = own[np.argsort(shard, kind="stable")]
        for s, k in _slices(np.sort(shard, kind="stable")):
            o = own[k]
            yield _row(s, kind, anchor[o], block[o], doc[o], at[o].astype("<u4"), count[o].astype(np.uint8))


def _removed(doc: np.ndarray, at: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, at, count = runs(doc, at, count)
    return doc.astype("<i8"), at.astype("<u4"), count.astype("<u4")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """Rows (sorted by shard) gathered shard by shard: lists of each kind's columns."""
    now, held = None, {}
    for b in batches:
        for shard, kind, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if shard != now:
                if held:
                    yield now, held
                now, held = shard, {}
            held.setdefault(kind, []).append(rest)
    if held:
        yield now, held


def _joined(rows: list[tuple], column: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


FOUND = "kind int, anchor long, doc long, at long, count long"


def _found(kind: int, anchor: np.ndarray | None, doc: np.ndarray, at: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    anchor = np.zeros(len(doc), np.int64) if anchor is None else anchor.view(np.int64)
    columns = [pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (anchor, doc, at, count))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "anchor", "doc", "at", "count"])


def _resolve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a shard: the repeated ones are removed, the first ones with an anchor of others are left to compare."""
    for _, held in _by_shard(batches):
        if done := held.get(REMOVED):
            yield _found(REMOVED, None, _joined(done, 0, "<i8"), _joined(done, 1, "<u4"), _joined(done, 2, "<u4"))
        rows = held.get(BLOCK, []) + held.get(FREQUENT_BLOCK, [])
        if not rows:
            continue
        anchor, block, doc = (_joined(rows, k, t) for k, t in ((0, "<u8"), (1, "<u8"), (2, "<i8")))
        at, count = _joined(rows, 3, "<u4").astype(np.int64), _joined(rows, 4, np.uint8).astype(np.int64)
        marked = np.concatenate([_joined(held.get(MARK, []), 0, "<u8"), _joined(held.get(FREQUENT_BLOCK, []), 0, "<u8")])
        names, back, crowd = np.unique(anchor, return_inverse=True, return_counts=True)
        frequent = np.isin(names, marked)[back]
        own = np.flatnonzero((crowd[back] > 1) | frequent)  # the others stand alone
        anchor, block, doc, at, count, frequent = (x[own] for x in (anchor, block, doc, at, count, frequent))
        order = np.lexsort((at, doc, block, anchor))
        anchor, block, doc, at, count, frequent = (x[order] for x in (anchor, block, doc, at, count, frequent))
        again = np.zeros(len(order), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (block[1:] == block[:-1])
        yield _found(REMOVED, None, *runs(doc[again], at[again], count[again]))
        anchor, doc, at, count, frequent = (x[~again] for x in (anchor, doc, at, count, frequent))
        _, back, crowd = np.unique(anchor, return_inverse=True, return_counts=True)
        for kind, own in ((BLOCK, (crowd[back] > 1) & ~frequent), (FREQUENT_BLOCK, frequent)):
            if own.any():
                yield _found(kind, anchor[own], doc[own], at[own], count[own])


def _lists(column: pa.Array, field: int) -> np.ndarray:
    return column.flatten().field(field).to_numpy(zero_copy_only=False)


def _sizes(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)


def _bytes_of(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple]:
    """From (doc, text, blocks): blocks with their bytes, by anchor; windows of frequent anchors, by hash."""
    for b in batches:
        whole, first, end = byte_spans(b.column(1))
        kind, anchor, at, count = (_lists(b.column(2), k) for k in range(4))
        size = _sizes(b.column(2))
        doc = np.repeat(b.column(0).to_numpy(zero_copy_only=False), size)
        begin = np.repeat(first, size) + at
        own = np.flatnonzero(kind == BLOCK)
        shard = _shard(anchor[own].view(U), bits)
        own, shard = own[np.argsort(shard, kind="stable")], np.sort(shard, kind="stable")
        for s, k in _slices(shard):
            o = own[k]
            yield _row(s, BLOCK, doc[o].astype("<i8"), at[o].astype("<u4"), count[o].astype(np.uint8), whole[ragged(begin[o], count[o] + LENGTH - 1)], anchor[o])
        own = np.flatnonzero(kind == FREQUENT_BLOCK)
        for i in range(0, len(own), 20_000):
            o = own[i : i + 20_000]
            piece = whole[ragged(begin[o], count[o] + LENGTH - 1)]
            first = np.cumsum(count[o] + LENGTH - 1) - (count[o] + LENGTH - 1)
            start = ragged(first, count[o])
            one, two = span_hash(piece, start, start + LENGTH // 2), span_hash(piece, start + LENGTH // 2, start + LENGTH)
            wdoc, wat = np.repeat(doc[o], count[o]), ragged(at[o], count[o])
            order = np.lexsort((wat, wdoc, two, one))
            one, two, wdoc, wat = one[order], two[order], wdoc[order], wat[order]
            again = np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])])
            if again.any():
                yield _row(i % (1 << bits), REMOVED, *_removed(wdoc[again], wat[again]))
            one, two, wdoc, wat = one[~again], two[~again], wdoc[~again], wat[~again]
            present = np.unique(_shard(one, bits))
            cut = np.searchsorted(one, present.astype(U) << U(64 - bits))
            for s, x, y in zip(present.tolist(), cut, np.append(cut[1:], len(one)), strict=True):
                yield _row(s, FREQUENT_BLOCK, wdoc[x:y].astype("<i8"), wat[x:y].astype("<u4"), one[x:y], two[x:y])


def _resolve_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of a shard that have an equal one earlier."""
    for _, held in _by_shard(batches):
        if done := held.get(REMOVED):
            yield _found(REMOVED, None, _joined(done, 0, "<i8"), _joined(done, 1, "<u4"), _joined(done, 2, "<u4"))
        if rows := held.get(FREQUENT_BLOCK):
            doc, at, one, two = (_joined(rows, k, t) for k, t in enumerate(("<i8", "<u4", "<u8", "<u8")))
            yield _found(REMOVED, None, *runs(*_later(doc, at.astype(np.int64), two, one)))
        if rows := held.get(BLOCK):
            doc, at, count = _joined(rows, 0, "<i8"), _joined(rows, 1, "<u4").astype(np.int64), _joined(rows, 2, np.uint8).astype(np.int64)
            pieces, anchor = _joined(rows, 3, np.uint8), _joined(rows, 4, "<u8")
            size = count + LENGTH - 1
            begin = np.cumsum(size) - size
            order = np.argsort(anchor, kind="stable")
            # Arrays of whole groups of one anchor.
            edge = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
            total = np.cumsum(size[order])
            part = (np.append(total[edge[1:] - 1], total[-1]) // ARRAY_BYTES).repeat(np.diff(np.append(edge, len(order))))
            for _, k in _slices(part):
                o = order[k]
                yield _found(REMOVED, None, *runs(*repeated_windows(pieces[ragged(begin[o], size[o])], count[o], doc[o], at[o])))


def repeat_spans(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """For docs (doc, text) with distinct doc: the texts dealt by doc, and (doc, spans), spans an array of (at, count):
    the windows at, ..., at + count - 1 are to be removed. Spans may overlap."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(3, int(np.ceil(np.log2(max(1, size / shard_bytes))))))
    parts = min(1 << bits, MOST_PARTS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, n, salt = [], 0, 0
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for g in grouped(b.column(1)):
                    anchor, block, text, at, count = blocks(g)
                    held.append((anchor, block, ids[g.first + text], at, count))
                    n += len(anchor)
                    salt += len(g.buf)
                    if n >= FLUSH_BLOCKS:
                        yield from _sent_blocks(*(np.concatenate(x) for x in zip(*held, strict=True)), bits, salt)
                        held, n = [], 0
            if held:
                yield from _sent_blocks(*(np.concatenate(x) for x in zip(*held, strict=True)), bits, salt)

        yield from _batches(rows())

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "shard").sortWithinPartitions("shard")

    found = materialize(dealt(docs.mapInArrow(giving_back(send), SCHEMA)).mapInArrow(giving_back(_resolve_blocks), FOUND), "blocks")
    texts = docs.repartition(parts, "doc")
    wanted = found.where(F.col("kind") != REMOVED).groupBy("doc").agg(F.collect_list(F.struct("kind", "anchor", "at", "count")).alias("blocks"))
    fetched = texts.join(wanted, "doc").select("doc", "text", "blocks")
    edges = dealt(fetched.mapInArrow(giving_back(lambda it: _batches(_bytes_of(it, bits))), SCHEMA)).mapInArrow(giving_back(_resolve_windows), FOUND)
    spans = found.where(F.col("kind") == REMOVED).select("doc", "at", "count").unionByName(edges.select("doc", "at", "count"))
    return texts, spans.groupBy("doc").agg(F.collect_list(F.struct("at", "count")).alias("spans"))


def _kept(text: bytes, at: np.ndarray, count: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal runs (start, end) that are removed."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + count + LENGTH - 1, -1)
    off = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turn = np.flatnonzero(off[1:] != off[:-1])
    return np.frombuffer(text, np.uint8)[~off[1:-1]].tobytes(), list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans (array of start, end).

    Texts are UTF-8 bytes; a null one is empty. A string is earlier in a smaller doc_id, or nearer to the start of the
    same document. Rows that share a doc_id, or have none (earliest of all), are documents of their own, ordered by the
    hash of their texts; of rows repeated in full one is earlier. Texts below LENGTH bytes lose nothing. Other columns
    are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    if shared:
        keyed = rows.withColumnRenamed("doc_id", "doc")
        back = None
    else:
        # Keys in the order of documents: rows sorted over all partitions, then numbered.
        h = F.xxhash64("text")
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        table = materialize(rows.repartitionByRange(n, "doc_id", h).sortWithinPartitions("doc_id", h).withColumn("doc", F.monotonically_increasing_id()), "keyed")
        keyed, back = table.select("doc", "text"), table.select("doc", "doc_id")
    texts, spans = repeat_spans(keyed, shard_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            at, count = _lists(b.column(2), 0), _lists(b.column(2), 1)
            size = _sizes(b.column(2))
            edge = np.cumsum(size)
            for i in range(0, len(b), 500):
                n_bytes, kept, removed = [], [], []
                for k, text in enumerate(as_bytes(b.column(1)[i : i + 500]), i):
                    s = slice(edge[k] - size[k], edge[k])
                    left, gone = _kept(text, at[s], count[s]) if size[k] else (bytes(text), [])
                    n_bytes.append(len(text))
                    kept.append(left)
                    removed.append([{"start": x, "end": y} for x, y in gone])
                arrays = [
                    b.column(0)[i : i + 500], pa.array(n_bytes, pa.int64()), pa.array([x - len(y) for x, y in zip(n_bytes, kept, strict=True)], pa.int64()),
                    pa.array([len(x) for x in removed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()), pa.array(removed, kind),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>"
    none = F.array().cast("array<struct<at: long, count: long>>")
    out = texts.join(spans, "doc", "left").select("doc", "text", F.coalesce("spans", none).alias("spans")).mapInArrow(giving_back(cut), schema)
    return out.withColumnRenamed("doc", "doc_id") if back is None else out.join(back, "doc").select("doc_id", *out.columns[1:])


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
