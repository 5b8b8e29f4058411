"""PBM, PGM, PPM, PFM and PAM."""

from __future__ import annotations

import re
import warnings

import numpy as np

from ..options import ReadOptions
from ..schema import Alpha, ByteOrder, FileFormat, Format, ImageError
from .bmp import Head, whole

_SKIP = re.compile(rb"(?:[ \t\r\n\v\f]|#[^\r\n]*)*")
_NUMBER = re.compile(rb"\d+")
_REAL = re.compile(rb"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


class _Cursor:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, pattern: re.Pattern[bytes]) -> bytes:
        self.at = _SKIP.match(self.data, self.at).end()
        m = pattern.match(self.data, self.at)
        if not m:
            raise ImageError("a number is missing in the header")
        self.at = m.end()
        return m[0]

    def number(self) -> int:
        return int(self.take(_NUMBER))

    def raster(self) -> int:
        """The place after the single white space that follows the header."""
        return self.at + 1


def _checked(width: int, height: int, options: ReadOptions) -> None:
    if width <= 0 or height <= 0:
        raise ImageError("width and height must be positive")
    if width * height > options.max_pixels:
        raise ImageError("more pixels than maxPixels")


def scaled(v: np.ndarray, maxval: int) -> np.ndarray:
    """Samples brought to 0..255, or 0..65535 above 255: trunc(v * ratio) in float32, clamped."""
    top = 255 if maxval <= 255 else 65535
    if maxval == top:
        out = np.minimum(v, top)
    else:
        out = np.minimum(np.trunc(v.astype(np.float32) * (np.float32(top) / np.float32(maxval))), top)
    return out.astype(np.uint8 if top == 255 else ">u2")


#: Stands behind the numbers of a text. numpy gives whatever was in memory for numbers that a text doesn't have.
_BETWEEN = -(1 << 40)


def _numbers(text: bytes, n: int) -> np.ndarray:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)  # text that isn't a number ends the numbers
        return np.fromstring(text + b" %d " % _BETWEEN, np.int64, n, sep=" ")


def _ascii(data: bytes, n: int) -> np.ndarray:
    """The first n numbers; what follows them doesn't count."""
    v = _numbers(re.sub(rb"#[^\r\n]*", b" ", data) if b"#" in data else data, n)
    if len(v) < n or (v == _BETWEEN).any():
        raise ImageError("samples are missing, or one isn't a number")
    return v


def _ascii_rows(raw: np.ndarray, n: int) -> np.ndarray:
    return np.stack([_ascii(r.tobytes(), n) for r in raw])


def samples_of_many(texts: list[bytes], n: int, maxval: int) -> np.ndarray:
    """(files, bytes of n samples) of texts of exactly n numbers each."""
    text = (b" %d " % _BETWEEN).join(texts)
    if b"#" in text:
        raise ImageError("a comment")
    v = _numbers(text, len(texts) * (n + 1)).reshape(len(texts), n + 1)
    if (v[:, n] != _BETWEEN).any() or (v[:, :n] == _BETWEEN).any():
        raise ImageError("a text has other than n numbers")
    return _bytes(scaled(v[:, :n], maxval)).reshape(len(texts), -1)


def text_size(data: bytes) -> tuple[int, int]:
    """(numbers that follow the header, maxval) of P2 and P3."""
    c = _Cursor(data, 2)
    width, height, maxval = c.number(), c.number(), c.number()
    return width * height * (3 if data[:2] == b"P3" else 1), maxval


def _binary(raw: np.ndarray, n: int, maxval: int) -> np.ndarray:
    """(files, n) samples of (files, bytes)."""
    size = 1 if maxval <= 255 else 2
    if raw.shape[1] < n * size:
        raise ImageError("samples are missing")
    raw = raw[:, : n * size]
    return raw if size == 1 else np.ascontiguousarray(raw).view(">u2")


def _bytes(v: np.ndarray) -> np.ndarray:
    return v if v.dtype == np.uint8 else np.ascontiguousarray(v).view(np.uint8)


def pbm(data: bytes, options: ReadOptions) -> dict:
    return whole("pbm", pbm_head(data, options), data, options)


def pbm_head(data: bytes, options: ReadOptions) -> Head:
    if data[:2] not in (b"P1", b"P4"):
        raise ImageError("wrong magic")
    c = _Cursor(data, 2)
    width, height = c.number(), c.number()
    _checked(width, height, options)
    fields = {"format": Format.BLACKWHITE, "file_format": FileFormat.PBM, "width": width, "height": height, "bytes_per_pixel": 1, "bits_per_pixel": 8, "bits_per_component": 8, "components": 1}

    def digits(raw: np.ndarray) -> np.ndarray:
        text = np.frombuffer(re.sub(rb"#[^\r\n]*", b"", raw.tobytes()), np.uint8)
        bits = text[(text == 48) | (text == 49)][: width * height] - 48
        if len(bits) < width * height:
            raise ImageError("samples are missing")
        return bits

    def packed(raw: np.ndarray) -> np.ndarray:
        row = (width + 7) // 8
        return np.unpackbits(_binary(raw, row * height, 255).reshape(-1, row), axis=1)[:, :width].reshape(len(raw), -1)

    plain = data[:2] == b"P1"
    at = c.at if plain else c.raster()
    return fields, at, at, lambda raw: ((1 - (np.stack([digits(r) for r in raw]) if plain else packed(raw))) * np.uint8(255)).astype(np.uint8)


def _gray_or_rgb(data: bytes, options: ReadOptions, ascii_: bytes, binary: bytes, comps: int, fmt: Format, kind: FileFormat) -> Head:
    if data[:2] not in (ascii_, binary):
        raise ImageError("wrong magic")
    c = _Cursor(data, 2)
    width, height, maxval = c.number(), c.number(), c.number()
    _checked(width, height, options)
    if not 0 < maxval < 65536:
        raise ImageError("maxval out of range")
    size = 1 if maxval <= 255 else 2
    fields = {"format": fmt, "file_format": kind, "width": width, "height": height, "bytes_per_pixel": comps * size, "bits_per_pixel": 8 * comps * size, "bits_per_component": 8 * size, "components": comps, "byte_order": ByteOrder.BIG if size == 2 else ByteOrder.HOST}
    n, plain = width * height * comps, data[:2] == ascii_
    at = c.at if plain else c.raster()
    return fields, at, at, lambda raw: _bytes(scaled(_ascii_rows(raw, n) if plain else _binary(raw, n, maxval), maxval))


def pgm(data: bytes, options: ReadOptions) -> dict:
    return whole("pgm", pgm_head(data, options), data, options)


def ppm(data: bytes, options: ReadOptions) -> dict:
    return whole("ppm", ppm_head(data, options), data, options)


def pgm_head(data: bytes, options: ReadOptions) -> Head:
    return _gray_or_rgb(data, options, b"P2", b"P5", 1, Format.GRAY, FileFormat.PGM)


def ppm_head(data: bytes, options: ReadOptions) -> Head:
    return _gray_or_rgb(data, options, b"P3", b"P6", 3, Format.RGB, FileFormat.PPM)


def quantised(v: np.ndarray) -> np.ndarray:
    """float32 samples to bytes: trunc(clamp(v, 0, 1) * 255)."""
    v = np.nan_to_num(v.astype(np.float32), nan=0.0)
    return np.trunc(np.clip(v, np.float32(0), np.float32(1)) * np.float32(255)).astype(np.uint8)


def pfm(data: bytes, options: ReadOptions) -> dict:
    return whole("pfm", pfm_head(data, options), data, options)


def pfm_head(data: bytes, options: ReadOptions) -> Head:
    m = re.match(rb"(PF4|PF|Pf)(?=\s)", data)
    if not m:
        raise ImageError("wrong magic")
    comps, fmt = {b"Pf": (1, Format.GRAY), b"PF": (3, Format.RGB), b"PF4": (4, Format.RGBA)}[m[1]]
    c = _Cursor(data, m.end())
    width, height, scale = c.number(), c.number(), float(c.take(_REAL))
    _checked(width, height, options)
    fields = {"format": fmt, "file_format": FileFormat.PFM, "width": width, "height": height, "bytes_per_pixel": comps, "bits_per_pixel": 8 * comps, "bits_per_component": 8, "components": comps, "alpha_info": Alpha.LAST if comps == 4 else Alpha.NONE, "top_down": False}
    n = width * height * comps

    def raster(raw: np.ndarray) -> np.ndarray:
        if raw.shape[1] < 4 * n:
            raise ImageError("samples are missing")
        return quantised(np.ascontiguousarray(raw[:, : 4 * n]).view("<f4" if scale < 0 else ">f4"))

    return fields, c.raster(), c.raster(), raster


_TUPLES = {
    b"BLACKANDWHITE": (Format.BLACKWHITE, 1, False), b"GRAYSCALE": (Format.GRAY, 1, False), b"RGB": (Format.RGB, 3, False),
    b"BLACKANDWHITE_ALPHA": (Format.GRAY_ALPHA, 2, True), b"GRAYSCALE_ALPHA": (Format.GRAY_ALPHA, 2, True), b"RGB_ALPHA": (Format.RGBA, 4, True),
}
_BY_DEPTH = {1: (Format.GRAY, False), 3: (Format.RGB, False), 4: (Format.RGBA, True)}


def pam(data: bytes, options: ReadOptions) -> dict:
    return whole("pam", pam_head(data, options), data, options)


def pam_head(data: bytes, options: ReadOptions) -> Head:
    if data[:2] != b"P7":
        raise ImageError("wrong magic")
    end = re.search(rb"^[ \t]*ENDHDR[^\n]*\n", data, re.M)
    if not end:
        raise ImageError("ENDHDR is missing")
    head: dict[bytes, bytes] = {}
    for line in re.sub(rb"#[^\n]*", b"", data[2 : end.start()]).splitlines():
        key, _, value = line.strip().partition(b" ")
        if key:
            head[key] = (head[key] + b" " if key == b"TUPLTYPE" and key in head else b"") + value.strip()

    def number(key: bytes) -> int | None:
        return int(head[key]) if re.fullmatch(rb"\d+", head.get(key, b"")) else None

    width, height, depth, maxval = (number(k) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    kind = _TUPLES.get(head.get(b"TUPLTYPE", b""))
    _checked(width or 0, height or 0, options)
    if not maxval or maxval > 65535:
        raise ImageError("MAXVAL is missing or out of range")
    depth = depth or (kind[1] if kind else None)
    if not depth:
        raise ImageError("neither DEPTH nor TUPLTYPE")
    fmt, alpha = kind[::2] if kind else _BY_DEPTH.get(depth, (Format.NONE, False))
    size = 1 if maxval <= 255 else 2
    fields = {"format": fmt, "file_format": FileFormat.PAM, "width": width, "height": height, "bytes_per_pixel": depth * size, "bits_per_pixel": 8 * depth * size, "bits_per_component": 8 * size, "components": depth, "alpha_info": Alpha.LAST if alpha else Alpha.NONE, "byte_order": ByteOrder.BIG if size == 2 else ByteOrder.HOST}
    return fields, end.end(), end.end(), lambda raw: _bytes(scaled(_binary(raw, width * height * depth, maxval), maxval))
