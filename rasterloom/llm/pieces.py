"""SentencePiece encoding and decoding in numpy, equal to the library's.

Texts are cut into segments that no piece spans (a run of spaces with the word after it); distinct
segments of one length stand as rows of a matrix and advance together. A prefix hash of each row
gives the hash of any substring, which is looked up among the sorted hashes of the pieces.

- Unigram models: Viterbi. For each end place, the candidates of all start places are looked up at
  once; the vectorised maximum and its backpointer are kept.
- BPE models: the best path isn't a sum of scores, so Viterbi gives other ids than the library does
  (on piece_bpe_32k for 60 % of distinct words, see README). There each step merges, in every
  row at once, the adjacent pair whose joined piece scores highest, leftmost among equals.

Characters without a piece become byte pieces, or the unknown piece where the model has none.

Scale: a map over whole texts, without a shuffle. The model is read once a worker, from a path that
all machines have (a parameter), or from bytes that were sent.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U, byte_spans, giving_back, mixed, powers, ragged

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a space in pieces
#: Longer segments are merged one by one, with a heap; shorter ones in matrices of so many cells at most.
LONG, CELLS = 48, 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model:
    """A SentencePiece model. Only the identity normaliser is covered: others raise ValueError."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(serialized)
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser are covered")
        self.prefix = norm.add_dummy_prefix
        self.unigram = m.trainer_spec.model_type == 1
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are covered")
        pieces = [(x.piece, x.score, x.type) for x in m.pieces]
        if any(t == USER for _, _, t in pieces):
            raise ValueError("user-defined pieces aren't covered")
        self.byte_id = np.full(256, -1, np.int32)
        self.unk = next(k for k, x in enumerate(pieces) if x[2] == UNKNOWN)
        for k, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(piece[3:5], 16)] = k
        if (self.byte_id < 0).any():
            self.byte_id[:] = -1
        normal = [(p, s, k) for k, (p, s, t) in enumerate(pieces) if t == NORMAL]
        if any(MARK in p.lstrip(MARK) for p, _, _ in normal):
            raise ValueError("pieces that span words aren't covered")
        self.find = {p: (s, k) for p, s, k in normal}
        key = np.array([_hashes(p)[0] for p, _, _ in normal], U)
        order = np.argsort(key)
        self.key = key[order]
        if (self.key[1:] == self.key[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.id = np.array([x[2] for x in normal], np.int32)[order]
        self.score = np.array([x[1] for x in normal], np.float32)[order]
        self.longest = max(len(x[0]) for x in normal)
        self.unk_score = float(min(x[1] for x in normal)) - 10.0
        text = [self._shown(p, t) for p, _, t in pieces]
        self.out_size = np.array([len(x) for x in text])
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out = np.frombuffer(b"".join(text), np.uint8)

    @staticmethod
    def _shown(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(MARK, " ").encode())

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the pieces with these hashes; -inf and -1 where there is none."""
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        hit = self.key[at] == h
        return np.where(hit, self.score[at], np.float32(-np.inf)), np.where(hit, self.id[at], -1)

    # Segments

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        return SEGMENT.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def _chars(self, text: str) -> list[int]:
        """Ids of a symbol without a piece."""
        if self.byte_id[0] < 0:
            return [self.unk]
        return [int(self.byte_id[b]) for b in text.encode("utf-8", "surrogatepass")]

    def encode_segments(self, segments: list[str]) -> list[np.ndarray]:
        """The ids of each segment."""
        out: list = [None] * len(segments)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            if n > LONG and not self.unigram:
                for k in own:
                    out[k] = np.array(self._merge_one(segments[k]), np.int32)
                continue
            step = max(1, CELLS // int(n))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                rows = [segments[k] for k in part]
                chars = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), n)
                ids = self._viterbi(rows, chars) if self.unigram else self._merge(rows, chars)
                for k, x in zip(part, ids, strict=True):
                    out[k] = x
        return out

    def _ids(self, rows: list[str], row: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """Splits symbols (in order of row) into rows, with bytes for those without a piece. With an unknown piece
        instead, neighbouring unknown symbols are one."""
        if self.byte_id[0] < 0:
            unknown = ids < 0
            again = np.zeros(len(ids), bool)
            again[1:] = unknown[1:] & unknown[:-1] & (row[1:] == row[:-1])
            row, ids = row[~again], np.where(unknown, self.unk, ids)[~again]
            return np.split(ids.astype(np.int32), np.searchsorted(row, np.arange(1, len(rows))))
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            count = np.ones(len(ids), np.int64)
            spelled = [self._chars(rows[row[k]][start[k] : end[k]]) for k in missing]
            count[missing] = [len(x) for x in spelled]
            flat = np.repeat(ids, count)
            flat[ragged(np.cumsum(count)[missing] - count[missing], count[missing])] = np.concatenate(spelled)
            row, ids = np.repeat(row, count), flat
        return np.split(ids.astype(np.int32), np.searchsorted(row, np.arange(1, len(rows))))

    def _merge(self, rows: list[str], chars: np.ndarray) -> list[np.ndarray]:
        """BPE. Every row still on has equally many symbols, as each step merges one pair in each."""
        r, n = chars.shape
        prefix = np.zeros((r, n + 1), U)
        np.cumsum((chars.astype(U) + U(1)) * powers(n + 1)[0][:n], axis=1, out=prefix[:, 1:])
        inverse = powers(n + 1)[1]

        def span(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            return _finished((prefix[row, end] - prefix[row, start]) * inverse[start], end - start)

        on = np.arange(r)
        bounds = np.tile(np.arange(n + 1), (r, 1))
        every = np.repeat(on, n - 1).reshape(r, n - 1)
        score = self.look_up(span(every, bounds[:, :-2], bounds[:, 2:]))[0] if n > 1 else np.zeros((r, 0), np.float32)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # (rows, their bounds)
        while len(on):
            m = bounds.shape[1] - 1
            if m == 1:
                done.append((on, bounds))
                break
            best = score.argmax(1)
            more = score[np.arange(len(on)), best] > -np.inf
            if not more.all():
                done.append((on[~more], bounds[~more]))
                on, bounds, score, best = on[more], bounds[more], score[more], best[more]
                if not len(on):
                    break
            k = np.arange(m)[None, :]
            bounds = np.take_along_axis(bounds, k + (k > best[:, None]), 1)
            if m == 2:
                score = np.zeros((len(on), 0), np.float32)
                continue
            k = np.arange(m - 2)[None, :]
            score = np.take_along_axis(score, k + (k >= best[:, None]), 1)
            for side in (best - 1, best):  # the pairs beside the merged symbol
                ok = np.flatnonzero((side >= 0) & (side < m - 2))
                s = side[ok]
                score[ok, s] = self.look_up(span(on[ok], bounds[ok, s], bounds[ok, s + 2]))[0]
        row = np.concatenate([np.repeat(o, b.shape[1] - 1) for o, b in done])
        start = np.concatenate([b[:, :-1].ravel() for _, b in done])
        end = np.concatenate([b[:, 1:].ravel() for _, b in done])
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        return self._ids(rows, row, start, end, self.look_up(span(row, start, end))[1])

    def _merge_one(self, text: str) -> list[int]:
        """BPE of one long segment: a heap of pairs, and links between symbols."""
        n = len(text)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (x := self.find.get(text[a : end[b]])):
                heapq.heappush(heap, (-x[0], a, end[a], end[b]))

        for k in range(n - 1):
            push(k, k + 1)
        gone = [False] * n
        while heap:
            _, a, a_end, b_end = heapq.heappop(heap)
            b = after[a]
            if gone[a] or end[a] != a_end or b < 0 or end[b] != b_end:
                continue
            end[a], gone[b], after[a] = b_end, True, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            push(before[a], a)
            push(a, after[a])
        out: list[int] = []
        k = 0
        while k >= 0:
            x = self.find.get(text[k : end[k]])
            got = [x[1]] if x else self._chars(text[k : end[k]])
            if not (got == [self.unk] and out[-1:] == [self.unk]):
                out += got
            k = after[k]
        return out

    def _viterbi(self, rows: list[str], chars: np.ndarray) -> list[np.ndarray]:
        """Unigram: the path of the greatest sum of scores; of equal ones that whose last piece is longest."""
        r, n = chars.shape
        prefix = np.zeros((r, n + 1), U)
        np.cumsum((chars.astype(U) + U(1)) * powers(n + 1)[0][:n], axis=1, out=prefix[:, 1:])
        inverse = powers(n + 1)[1]
        best = np.full((r, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((r, n + 1), np.int64)
        for e in range(1, n + 1):
            s = np.arange(max(0, e - self.longest), e)
            score = self.look_up(_finished((prefix[:, e : e + 1] - prefix[:, s]) * inverse[s], e - s))[0].astype(np.float64)
            score[:, -1] = np.where(np.isinf(score[:, -1]), self.unk_score, score[:, -1])
            total = best[:, s] + score
            k = total.argmax(1)
            best[:, e], back[:, e] = total[np.arange(r), k], s[k]
        row, start, end = [], [], []
        on, at = np.arange(r), np.full(r, n)
        while len(on):
            s = back[on, at]
            row.append(on)
            start.append(s)
            end.append(at)
            on, at = on[s > 0], s[s > 0]
        row, start, end = np.concatenate(row), np.concatenate(start), np.concatenate(end)
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        h = _finished((prefix[row, end] - prefix[row, start]) * inverse[start], end - start)
        return self._ids(rows, row, start, end, self.look_up(h)[1])

    # Whole texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each one's)."""
        place: dict[str, int] = {}
        flat, count = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = self.segments(text)
            count[k] = len(own)
            flat += [place.setdefault(s, len(place)) for s in own]
        ids = self.encode_segments(list(place))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        every = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        at = np.array(flat, np.int64)
        out = every[ragged((np.cumsum(size) - size)[at], size[at])]
        total = np.concatenate([[0], np.cumsum(size[at])])
        return out, total[np.concatenate([[0], np.cumsum(count)])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 of each text; the dummy prefix goes."""
        size = self.out_size[ids]
        raw = self.out[ragged(self.out_start[ids], size)].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])[bounds]
        out = [raw[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return [x[1:] if self.prefix and x[:1] == b" " else x for x in out]


SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _finished(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mixed(x + size.astype(U) * U(0xD6E8FEB86659FD93))


def _hashes(piece: str) -> np.ndarray:
    chars = np.array([[ord(c) for c in piece]], U) + U(1)
    return _finished((chars * powers(len(piece) + 1)[0][: len(piece)]).sum(1, dtype=U), np.array([len(piece)]))


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


#: Texts are taken together up to so many bytes.
BATCH_BYTES = 1 << 21


def _parts(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in parts of bounded size, in order; null counts as empty."""
    _, start, end = byte_spans(column)
    ends, k = np.cumsum(end - start + 1), 0
    while k < len(ends):
        after = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BATCH_BYTES, "right")))
        yield [x or "" for x in column[k:after].to_pylist()]
        k = after


def encode_table(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_bytes, decoded): decoded is whether decoding the ids gives the text's bytes again.

    A null text counts as empty; an empty one has no ids. A text that has U+2581 is decoded with spaces there, as by
    the library. Rows with a null doc_id, repeated rows and ties are encoded each on its own. Other columns are not
    read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            k = 0
            for part in _parts(b.column(1)):
                ids, bounds = model.encode(part)
                raw = [t.encode() for t in part]
                same = [x == y for x, y in zip(raw, model.decode(ids, bounds), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + len(part)], lists, pa.array([len(x) for x in raw], pa.int64()), pa.array(same)], ["doc_id", "ids", "n_bytes", "decoded"])
                k += len(part)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, ids array<int>, n_bytes long, decoded boolean")


def decode_table(rows: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Null ids give a null text, no ids an empty one; bytes that aren't UTF-8 become
    U+FFFD. Rows with a null doc_id, repeated rows and ties are decoded each on its own. Other columns are not read. An
    empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            lists = [None if x is None else np.array(x, np.int64) for x in b.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists])]).astype(np.int64)
            ids = np.concatenate([np.zeros(0, np.int64), *(x for x in lists if x is not None)])
            texts = [None if x is None else y.decode("utf-8", "replace") for x, y in zip(lists, model.decode(ids, bounds), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_ids, ids_hash (Spark's xxhash64 of the ids), round_trip."""
    rows = encode_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").alias("round_trip"))
