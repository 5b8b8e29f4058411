"""QOI."""

from __future__ import annotations

import struct

import numpy as np

from ..options import ReadOptions
from ..schema import Alpha, ByteOrder, ColorSpace, FileFormat, Format, ImageError, record


#: What files must have in common to be decoded together.
HEAD = 14


def qoi(data: bytes, options: ReadOptions) -> dict:
    fields = qoi_fields(data, options)
    if options.header_only:
        return record("qoi", **fields)
    return record("qoi", data=pixels(data, fields["width"] * fields["height"], fields["components"]), **fields)


def qoi_fields(data: bytes, options: ReadOptions) -> dict:
    if len(data) < 22 or data[:4] != b"qoif":
        raise ImageError("wrong magic")
    width, height, channels, space = struct.unpack_from(">IIBB", data, 4)
    if channels not in (3, 4):
        raise ImageError("channels must be 3 or 4")
    if not width or not height or width * height > options.max_pixels:
        raise ImageError("width or height out of range")
    return {
        "format": Format.RGB if channels == 3 else Format.RGBA, "file_format": FileFormat.QOI, "width": width, "height": height, "bytes_per_pixel": channels, "bits_per_pixel": 8 * channels,
        "bits_per_component": 8, "components": channels, "alpha_info": Alpha.LAST if channels == 4 else Alpha.NONE, "color_space": ColorSpace.LINEAR if space else ColorSpace.SRGB, "byte_order": ByteOrder.HOST,
    }


def pixels(data: bytes, total: int, channels: int) -> bytes:
    """The pixels of the operations from byte 14 to 8 bytes before the end; if they end early the last pixel goes on."""
    index = [(0, 0, 0, 0)] * 64
    r, g, b, a = 0, 0, 0, 255
    shown = bytes((r, g, b, a)[:channels])
    out: list[bytes] = []
    at, end, n = 14, len(data) - 8, 0
    while n < total and at < end:
        op = data[at]
        at += 1
        count = 1
        if op == 0xFE:
            r, g, b = data[at : at + 3]
            at += 3
        elif op == 0xFF:
            r, g, b, a = data[at : at + 4]
            at += 4
        elif op < 0x40:
            r, g, b, a = index[op]
        elif op < 0x80:
            r, g, b = (r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (b + (op & 3) - 2) & 255
        elif op < 0xC0:
            two = data[at]
            at += 1
            green = (op & 63) - 32
            r, g, b = (r + green - 8 + (two >> 4)) & 255, (g + green) & 255, (b + green - 8 + (two & 15)) & 255
        else:
            count = (op & 63) + 1
        index[(3 * r + 5 * g + 7 * b + 11 * a) & 63] = (r, g, b, a)
        shown = bytes((r, g, b, a)) if channels == 4 else bytes((r, g, b))
        out.append(shown * count if count > 1 else shown)
        n += count
    if n < total:
        out.append(shown * (total - n))
    return b"".join(out)[: total * channels]


def pixels_of_many(files: list[bytes], total: int, channels: int) -> np.ndarray:
    """(files, total * channels): like pixels, one operation of every file at a time."""
    size = max(map(len, files)) + 4
    body = np.frombuffer(b"".join(f.ljust(size, b"\0") for f in files), np.uint8)
    base, end = np.arange(len(files)) * size, np.array([len(f) - 8 for f in files])
    state = np.zeros((len(files), 4), np.uint8)
    state[:, 3] = 255
    index = np.zeros((len(files), 64, 4), np.uint8)
    out = np.zeros((len(files), total, 4), np.uint8)
    out[:, 0] = state
    start = np.zeros((len(files), total), np.intp)  # of the operation that a pixel comes from
    at, n = np.full(len(files), HEAD), np.zeros(len(files), np.int64)
    on = np.flatnonzero(at < end)
    while len(on):
        k = base[on] + at[on]
        op, one = body[k], body[k + 1]
        now = state[on]
        full = op >= 0xFE
        for j in range(4):
            pick = full if j < 3 else op == 0xFF
            now[pick, j] = body[k[pick] + 1 + j]
        seen = op < 0x40
        now[seen] = index[on[seen], op[seen]]
        diff = (op >= 0x40) & (op < 0x80)
        for j, shift in enumerate((4, 2, 0)):
            now[diff, j] += (op[diff] >> shift & 3) - np.uint8(2)
        luma = (op >= 0x80) & (op < 0xC0)
        green = (op[luma] & 63) - np.uint8(32)
        now[luma, 0] += green - np.uint8(8) + (one[luma] >> 4)
        now[luma, 1] += green
        now[luma, 2] += green - np.uint8(8) + (one[luma] & 15)
        index[on, (now * np.array([3, 5, 7, 11], np.uint8)).sum(1, dtype=np.uint8) & 63] = now
        state[on] = now
        out[on, n[on]] = now
        start[on, n[on]] = n[on]
        at[on] += 1 + np.where(op == 0xFF, 4, np.where(op == 0xFE, 3, luma))
        n[on] += np.where((op >= 0xC0) & ~full, (op & 63).astype(np.int64) + 1, 1)
        on = on[(n[on] < total) & (at[on] < end[on])]
    np.maximum.accumulate(start, axis=1, out=start)
    return out[np.arange(len(files))[:, None], start, :channels].reshape(len(files), -1)
