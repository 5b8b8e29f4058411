"""Baseline JPEG: Huffman codes bit by bit, everything after them in numpy for all blocks at once."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from ..options import ReadOptions
from ..schema import ColorSpace, FileFormat, Format, ImageError, Unsupported, record

ZIGZAG = np.array([k[2] * 8 + k[3] for k in sorted((x + y, (y if (x + y) % 2 else x), y, x) for y in range(8) for x in range(8))])


#: BASIS[pos, at]: what coefficient pos of a block adds to its sample at, in units of 2**-BASIS_BITS.
BASIS_BITS = 24
_C = np.where(np.arange(8) == 0, np.sqrt(0.5), 1)[:, None] * np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) / 2
BASIS = np.rint(np.einsum("vy,ux->vuyx", _C, _C).reshape(64, 64) * (1 << BASIS_BITS)).astype(np.int64)


def segments(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(marker, place after it, content) up to and with SOS, or EOI."""
    if data[:2] != b"\xff\xd8":
        raise ImageError("SOI is missing")
    at = 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ImageError("a marker is missing")
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            yield marker, at, b""
            return
        if marker == 1 or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > len(data):
            raise ImageError("a segment breaks off")
        size = struct.unpack_from(">H", data, at)[0]
        if size < 2 or at + size > len(data):
            raise ImageError("a segment breaks off")
        yield marker, at + size, data[at + 2 : at + size]
        if marker == 0xDA:
            return
        at += size


@lru_cache(maxsize=64)
def code_table(counts: bytes, values: bytes) -> tuple[list[int], list[int]]:
    """For each 16 bits that may come next: the length of the code they start with (0: none), and its symbol. Files of one
    encoder mostly share their tables, so these are kept."""
    length, symbol = [0] * 65536, [0] * 65536
    code = k = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            first = code << (16 - n)
            span = 1 << (16 - n)
            if first + span > 65536:
                raise ImageError("Huffman codes overflow")
            length[first : first + span] = [n] * span
            symbol[first : first + span] = [values[k]] * span
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


@lru_cache(maxsize=64)
def code_arrays(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    length, symbol = code_table(counts, values)
    return np.array(length), np.array(symbol)


class _Bits:
    """Entropy-coded bits: stuffed zeros go, a marker ends them (zeros follow)."""

    def __init__(self, data: bytes):
        end = 0
        while (k := data.find(b"\xff", end)) >= 0 and k + 1 < len(data) and data[k + 1] == 0:
            end = k + 2
        self.marker = data[k + 1] if 0 <= k < len(data) - 1 else 0xD9
        body = (data[:k] if k >= 0 else data).replace(b"\xff\x00", b"\xff")
        self.n = 8 * len(body)
        self.body, self.at = body + b"\0" * 8, 0
        self.over = 0

    def peek(self) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.body[k : k + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        k = self.at >> 3
        v = int.from_bytes(self.body[k : k + 4], "big") >> (32 - n - (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return v


def _scan(bits: _Bits, comps: list[dict], mcus: int) -> None:
    """Fills each component's coefficients, in scan order of its blocks, prediction undone later."""
    at_end = bits.n
    for mcu in range(mcus):
        for c in comps:
            dc_length, dc_symbol = code_table(*c["dc"])
            ac_length, ac_symbol = code_table(*c["ac"])
            for b in range(c["h"] * c["v"]):
                block = c["coefficients"][mcu * c["h"] * c["v"] + b]
                p = bits.peek()
                n = dc_length[p]
                if not n or bits.at + n > at_end:
                    raise ImageError("a code is missing or unknown")
                bits.at += n
                t = dc_symbol[p]
                if t > 15:
                    raise ImageError("a DC category is out of range")
                if t:
                    v = bits.take(t)
                    block[0] = v if v >= 1 << (t - 1) else v - (1 << t) + 1
                k = 1
                while k < 64:
                    p = bits.peek()
                    n = ac_length[p]
                    if not n or bits.at + n > at_end:
                        raise ImageError("a code is missing or unknown")
                    bits.at += n
                    rs = ac_symbol[p]
                    s = rs & 15
                    if not s:
                        if rs != 0xF0:
                            break
                        k += 16
                        continue
                    k += rs >> 4
                    if k > 63:
                        raise ImageError("coefficients overflow")
                    v = bits.take(s)
                    block[k] = v if v >= 1 << (s - 1) else v - (1 << s) + 1
                    k += 1


_W = {1: 2841, 2: 2676, 3: 2408, 5: 1609, 6: 1108, 7: 565}


def _butterfly(c: list[np.ndarray], shift: int, rounding: int) -> list[np.ndarray]:
    """One 8-point pass. c: coefficients in order, c[0] and c[4] scaled; shift: applied within the odd and even parts."""
    odd = _W[7] * (c[1] + c[7]) + rounding
    a1, a7 = (odd + (_W[1] - _W[7]) * c[1]) >> shift, (odd - (_W[1] + _W[7]) * c[7]) >> shift
    odd = _W[3] * (c[5] + c[3]) + rounding
    a5, a3 = (odd - (_W[3] - _W[5]) * c[5]) >> shift, (odd - (_W[3] + _W[5]) * c[3]) >> shift
    even = _W[6] * (c[2] + c[6]) + rounding
    e6, e2 = (even - (_W[2] + _W[6]) * c[6]) >> shift, (even + (_W[2] - _W[6]) * c[2]) >> shift
    top, low = c[0] + c[4], c[0] - c[4]
    s1, d1, s7, d7 = a1 + a5, a1 - a5, a7 + a3, a7 - a3
    u, v = (181 * (d1 + d7) + 128) >> 8, (181 * (d1 - d7) + 128) >> 8
    p, q, r, s = top + e2, top - e2, low + e6, low - e6
    return [p + s1, r + u, s + v, q + s7, q - s7, s - v, r - u, p - s1]


def inverse_dct(blocks: np.ndarray) -> np.ndarray:
    """Fixed-point inverse DCT of (n, 8, 8) int16 coefficients: rows, then columns, then +128 and clamp."""
    x = blocks.astype(np.int32)
    c = [x[:, :, k] for k in range(8)]
    plain = (x[:, :, 1:] == 0).all(2)
    rows = _butterfly([(c[0] << 11) + 128, *c[1:4], c[4] << 11, *c[5:]], 0, 0)
    rows = np.stack([np.where(plain, c[0] << 3, v >> 8) for v in rows], axis=2).astype(np.int16).astype(np.int32)
    c = [rows[:, k, :] for k in range(8)]
    columns = _butterfly([(c[0] << 8) + 8192, *c[1:4], c[4] << 8, *c[5:]], 3, 4)
    out = np.stack([v >> 14 for v in columns], axis=1).astype(np.int16).astype(np.int32)
    return np.clip(out + 128, 0, 255).astype(np.uint8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """(..., 3) RGB bytes: truncated toward zero, clamped."""
    y, cb, cr = y.astype(np.float64), cb.astype(np.float64) - 128, cr.astype(np.float64) - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.trunc(rgb), 0, 255).astype(np.uint8)


def _read(data: bytes, options: ReadOptions) -> tuple[dict, list[dict], bytes]:
    """The record's fields, the frame's components with their tables, and the scan's bytes (empty for the header alone)."""
    if data[:3] != b"\xff\xd8\xff":
        raise ImageError("wrong magic")
    quant: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    frame: list[dict] | None = None
    comments: list[str] = []
    scan = b""
    hres = vres = 0
    for marker, after, body in segments(data):
        if marker == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 12:
            hres, vres = struct.unpack_from(">HH", body, 8)
        elif marker == 0xFE:
            comments.append(body.decode("latin-1"))
        elif marker == 0xDB:
            at = 0
            while at < len(body):
                wide, place = body[at] >> 4, body[at] & 15
                size = 128 if wide else 64
                if place > 3 or wide > 1 or at + 1 + size > len(body):
                    raise ImageError("DQT out of range")
                table = np.zeros(64, np.int32)
                table[ZIGZAG] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1)
                quant[place] = table
                at += 1 + size
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                n = sum(counts)
                if len(counts) < 16 or n > 256 or at + 17 + n > len(body):
                    raise ImageError("DHT out of range")
                codes[body[at] >> 4, body[at] & 15] = own = counts, body[at + 17 : at + 17 + n]
                code_table(*own)  # fails if the codes don't fit
                at += 17 + n
        elif marker == 0xC0:
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise ImageError("SOF0 breaks off")
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            frame = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "tq": body[8 + 3 * k]} for k in range(n)]
            if precision != 8 or not height:
                raise Unsupported("precision, or a height given later")
            if not width or width * height > options.max_pixels or any(not (1 <= c["h"] <= 4 and 1 <= c["v"] <= 4) for c in frame):
                raise ImageError("SOF0 out of range")
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Unsupported("only baseline frames are covered")
        elif marker == 0xDD and body[:2] != b"\0\0":
            raise Unsupported("restart intervals")
        elif marker == 0xDA:
            if frame is None:
                raise ImageError("SOS before SOF0")
            n = body[0] if body else 0
            if len(body) < 1 + 2 * n:
                raise ImageError("SOS breaks off")
            if n != len(frame) or n != 3:
                raise Unsupported("only interleaved scans of three components are covered")
            scan = data[after:]
            for k in range(n):
                own = [c for c in frame if c["id"] == body[1 + 2 * k]]
                if not own:
                    raise ImageError("SOS names an unknown component")
                own[0]["tables"] = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            break
    if frame is None:
        raise ImageError("SOF0 is missing")
    fields = {
        "format": Format.RGB, "file_format": FileFormat.JPEG, "width": width, "height": height, "bytes_per_pixel": 3, "bits_per_pixel": 24, "bits_per_component": 8, "components": 3,
        "hres": hres, "vres": vres, "color_space": ColorSpace.SRGB, "comments": comments,
    }
    if options.header_only:
        return fields, frame, b""
    if not scan:
        raise ImageError("SOS is missing")
    for c in frame:
        try:
            c["dc"], c["ac"], c["q"] = codes[0, c["tables"][0]], codes[1, c["tables"][1]], quant[c["tq"]]
        except KeyError as e:
            raise ImageError("a table is missing") from e
    return fields, frame, scan


def _units(fields: dict, frame: list[dict]) -> tuple[int, int]:
    """Units of the scan in a row, and rows of them."""
    return -(-fields["width"] // (8 * max(c["h"] for c in frame))), -(-fields["height"] // (8 * max(c["v"] for c in frame)))


def _blocks(fields: dict, frame: list[dict], scan: bytes) -> list[np.ndarray]:
    """Each component's dequantised coefficients (blocks in the order of the scan, 64)."""
    across, down = _units(fields, frame)
    for c in frame:
        # Lists: element access is several times faster than in arrays.
        c["coefficients"] = [[0] * 64 for _ in range(across * down * c["h"] * c["v"])]
    _scan(_Bits(scan), frame, across * down)
    return [_dequantised(np.array(c.pop("coefficients"), np.int32), c["q"]) for c in frame]


def _dequantised(flat: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(..., blocks, 64) coefficients in zigzag order and predicted, as they were before."""
    flat[..., 0] = np.cumsum(flat[..., 0], axis=-1)
    blocks = np.zeros_like(flat)
    blocks[..., ZIGZAG] = flat
    return (blocks * q).astype(np.int16)


def coefficients(data: bytes) -> list[tuple[np.ndarray, dict]]:
    """(dequantised coefficients, component) of each component."""
    fields, frame, scan = _read(data, ReadOptions())
    return list(zip(_blocks(fields, frame, scan), frame, strict=True))


def jpeg(data: bytes, options: ReadOptions) -> dict:
    fields, frame, scan = _read(data, options)
    if options.header_only:
        return record("jpeg", **fields)
    return record("jpeg", data=_colours(fields, frame, [b[None] for b in _blocks(fields, frame, scan)])[0].tobytes(), **fields)


def _colours(fields: dict, frame: list[dict], coefficients: list[np.ndarray]) -> np.ndarray:
    """(files, height, width, 3) of each component's coefficients (files, blocks, 64)."""
    width, height = fields["width"], fields["height"]
    hmax, vmax = max(c["h"] for c in frame), max(c["v"] for c in frame)
    across, down = _units(fields, frame)
    planes = []
    for c, blocks in zip(frame, coefficients, strict=True):
        px = inverse_dct(blocks.reshape(-1, 8, 8)).reshape(-1, down, across, c["v"], c["h"], 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(-1, down * c["v"] * 8, across * c["h"] * 8)
        rows, columns = np.arange(height) * c["v"] // vmax, np.arange(width) * c["h"] // hmax
        planes.append(px[:, rows[:, None], columns])
    return to_rgb(*planes)


class _ManyBits:
    """Like _Bits, for many scans of files: a place in each."""

    def __init__(self, scans: list[bytes]):
        own = [_Bits(s) for s in scans]
        size = max(len(b.body) for b in own)
        body = np.frombuffer(b"".join(b.body.ljust(size, b"\0") for b in own), np.uint8).reshape(len(own), size).astype(np.int64)
        # The 32 bits from each byte on, all in one array.
        self.words = (body[:, :-3] << 24 | body[:, 1:-2] << 16 | body[:, 2:-1] << 8 | body[:, 3:]).ravel()
        self.base, self.end = np.arange(len(own)) * (size - 3), np.array([b.n for b in own])
        self.at = np.zeros(len(own), np.int64)
        self.sound = np.ones(len(own), bool)

    def code(self, on: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The files of on that go on, and the symbols of their next codes; others aren't sound."""
        at = self.at[on]
        p = self.words[self.base[on] + (at >> 3)] >> (16 - (at & 7)) & 0xFFFF
        n = table[0][p]
        good = (n > 0) & (at + n <= self.end[on])
        self.sound[on[~good]] = False
        self.at[on] = at + n
        return on[good], table[1][p[good]]

    def number(self, on: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers of n bits, 1 to 15, extended."""
        at = self.at[on]
        v = self.words[self.base[on] + (at >> 3)] >> (32 - n - (at & 7)) & ((1 << n) - 1)
        self.at[on] = at + n
        return np.where(v >= 1 << (n - 1), v, v - (1 << n) + 1)


def _scan_many(bits: _ManyBits, comps: list[dict], mcus: int) -> list[np.ndarray]:
    """Like _scan: a code of every file at a time. (files, blocks, 64) of each component."""
    out = [np.zeros((len(bits.at), mcus * c["h"] * c["v"], 64), np.int32) for c in comps]
    tables = [[code_arrays(*c[k]) for k in ("dc", "ac")] for c in comps]
    for mcu in range(mcus):
        for c, (dc, ac), flat in zip(comps, tables, out, strict=True):
            for block in range(mcu * c["h"] * c["v"], (mcu + 1) * c["h"] * c["v"]):
                on, t = bits.code(np.flatnonzero(bits.sound), dc)
                bits.sound[on[t > 15]] = False
                on, t = on[t < 16], t[t < 16]
                some = on[t > 0]
                flat[some, block, 0] = bits.number(some, t[t > 0])
                k = np.ones(len(bits.at), np.int64)
                while len(on):
                    on, rs = bits.code(on, ac)
                    size = rs & 15
                    k[on[rs == 0xF0]] += 16
                    some, n = on[size > 0], size[size > 0]
                    k[some] += rs[size > 0] >> 4
                    far = k[some] > 63
                    bits.sound[some[far]] = False
                    some, n = some[~far], n[~far]
                    flat[some, block, k[some]] = bits.number(some, n)
                    k[some] += 1
                    on = on[((size > 0) | (rs == 0xF0)) & (k[on] < 64)]
    return out


def head_size(data: bytes, options: ReadOptions) -> int:
    """The place where the scan begins."""
    return len(data) - len(_read(data, options)[2])


def jpeg_many(files: list[bytes], options: ReadOptions) -> tuple[np.ndarray, np.ndarray]:
    """Which of files that are equal up to their scans are sound, and the samples of these."""
    fields, frame, scan = _read(files[0], options)
    at = len(files[0]) - len(scan)
    across, down = _units(fields, frame)
    bits = _ManyBits([f[at:] for f in files])
    blocks = [_dequantised(flat[bits.sound], c["q"]) for flat, c in zip(_scan_many(bits, frame, across * down), frame, strict=True)]
    return bits.sound, _colours(fields, frame, blocks).reshape(np.count_nonzero(bits.sound), -1)
