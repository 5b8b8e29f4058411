"""Vectorised kernels over whole texts: many documents stand in one byte buffer, and each step runs over all of it.

Arithmetic on uint64 wraps on purpose throughout.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken together up to so many bytes; a longer one stands alone. Steps hold about a hundred bytes for each.
GROUP_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word characters where punctuation should not count: letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

_RANDOM = np.random.default_rng(20240229)
BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, U)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers of the base, before each place and at the end."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


#: Keeps the first k bytes of a lane of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Spans beyond so many bytes are hashed by pieces of that length, and then over the pieces' hashes.
_PIECE = 512


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans of buf: equal for equal contents wherever they stand. Lanes of eight bytes are chained through
    a bijection that spreads every bit, so no regular content cancels out, and spans of at most eight bytes and one length
    never share a hash."""
    size = (end - start).astype(np.int64)
    acc = mixed(size.astype(U) * U(0xD6E8FEB86659FD93) + U(1))
    lane = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    at, on = start.astype(np.int64), np.flatnonzero((size > 0) & (size <= _PIECE))
    while len(on):
        here = at[on]
        acc[on] = mixed(acc[on] ^ (lane[here] & _FIRST[np.minimum(end[on] - here, 8)]))
        at[on] += 8
        on = on[at[on] < end[on]]
    long = np.flatnonzero(size > _PIECE)
    if len(long):
        pieces = -(-size[long] // _PIECE)
        last = np.cumsum(pieces)
        begin = np.repeat(start[long], pieces) + _PIECE * (np.arange(last[-1]) - np.repeat(last - pieces, pieces))
        parts = span_hash(buf, begin, np.minimum(begin + _PIECE, np.repeat(end[long], pieces)))
        acc[long] = mixed(acc[long] ^ span_hash(parts.view(np.uint8), 8 * (last - pieces), 8 * last))
    return acc


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mixed(a * U(0xFF51AFD7ED558CCD) + np.bitwise_xor(b, U(0xC4CEB9FE1A85EC53)) * U(0x2545F4914F6CDD1D))


class Texts:
    """Some documents in one buffer, each followed by a newline.

    first: the index of the first one in its batch; n: their number; start, end: where their bytes stand in buf.
    """

    def __init__(self, texts: list[bytes | memoryview], first: int):
        self.first, self.n = first, len(texts)
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size

    def __len__(self) -> int:
        return self.n

    def words(self, inside: np.ndarray, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes in the class `inside`, and for each document
        (and the end) how many come earlier. Newlines must be outside."""
        on = inside[self.buf if buf is None else buf]
        edge = np.empty(len(on), bool)
        edge[0] = on[0]
        np.not_equal(on[1:], on[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        start, end = at[::2], at[1::2]
        return start, end, np.append(np.searchsorted(start, self.start), len(start))


def byte_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of the texts of a column, read in place; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        none = np.zeros(len(column), np.int64)
        return np.zeros(0, np.uint8), none, none
    edge = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    start, end = edge[:-1], edge[1:]
    if column.null_count:
        end = np.where(column.is_valid().to_numpy(zero_copy_only=False), end, start)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), start, end


def as_bytes(column: pa.Array) -> list[memoryview]:
    """The texts as UTF-8, read in place; null counts as empty."""
    data, start, end = byte_spans(column)
    view = memoryview(data)
    return [view[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]


def grouped(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[Texts]:
    """The texts of a column in groups of bounded size, in order."""
    data, start, end = byte_spans(column)
    view, k = memoryview(data), 0
    ends = np.cumsum(end - start + 1)
    while k < len(ends):
        after = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
        yield Texts([view[i:j] for i, j in zip(start[k:after].tolist(), end[k:after].tolist(), strict=True)], k)
        k = after


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow; when it ends, its worker returns freed memory to the system, as idle workers keep theirs."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between successive bounds; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[0], start[0]+1, ... (size[0] of them), then those of start[1], and so on."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - size), size)


_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of buf."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lane8 = np.ndarray((len(buf),), "<u8", padded, strides=(1,))
    lane4 = np.ndarray((len(buf),), "<u4", padded, strides=(1,))
    size, at = end - start, start.copy()
    acc = np.full(len(start), (seed + int(_P5)) % 2**64, U)
    long = np.flatnonzero(size >= 32)
    if len(long):
        v = [np.full(len(long), (seed + x) % 2**64, U) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        left, p, on = size[long] // 32, at[long], np.arange(len(long))
        while len(on):
            for k in range(4):
                v[k][on] = _rotated(v[k][on] + lane8[p[on] + 8 * k] * _P2, 31) * _P1
            p[on] += 32
            left[on] -= 1
            on = on[left[on] > 0]
        h = _rotated(v[0], 1) + _rotated(v[1], 7) + _rotated(v[2], 12) + _rotated(v[3], 18)
        for k in range(4):
            h = (h ^ (_rotated(v[k] * _P2, 31) * _P1)) * _P1 + _P4
        acc[long], at[long] = h, p
    acc += size.astype(U)
    on = np.flatnonzero(end - at >= 8)
    while len(on):
        h = acc[on] ^ (_rotated(lane8[at[on]] * _P2, 31) * _P1)
        acc[on] = _rotated(h, 27) * _P1 + _P4
        at[on] += 8
        on = on[end[on] - at[on] >= 8]
    on = np.flatnonzero(end - at >= 4)
    acc[on] = _rotated(acc[on] ^ (lane4[at[on]].astype(U) * _P1), 23) * _P2 + _P3
    at[on] += 4
    on = np.flatnonzero(at < end)
    while len(on):
        acc[on] = _rotated(acc[on] ^ (buf[at[on]].astype(U) * _P5), 11) * _P1
        at[on] += 1
        on = on[at[on] < end[on]]
    acc = (acc ^ (acc >> U(33))) * _P2
    acc = (acc ^ (acc >> U(29))) * _P3
    return acc ^ (acc >> U(32))
