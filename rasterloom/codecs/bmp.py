"""BMP and DIB: all depths, masks, palettes and run-length codes."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from ..options import ReadOptions
from ..schema import Alpha, ColorSpace, FileFormat, Format, ImageError, Unsupported, record

RGB, RLE8, RLE4, BITFIELDS, JPEG, PNG, ALPHABITFIELDS, CMYK, CMYKRLE8, CMYKRLE4 = 0, 1, 2, 3, 4, 5, 6, 11, 12, 13
RLE24 = 4  # in OS/2 2.x headers, which also use 3 for another code


#: A file's record but for its samples; the bytes up to which files must be equal to share it; where the pixels begin; and
#: the samples of files (n, bytes from the pixels on) that share it.
Head = tuple[dict, int, int, Callable[[np.ndarray], np.ndarray]]


def bmp(data: bytes, options: ReadOptions) -> dict:
    return whole("bmp", bmp_head(data, options), data, options)


def dib(data: bytes, options: ReadOptions) -> dict:
    return whole("dib", dib_head(data, options), data, options)


def whole(codec: str, head: Head, data: bytes, options: ReadOptions) -> dict:
    """The record of one file."""
    fields, _, at, raster = head
    if options.header_only:
        return record(codec, **fields)
    return record(codec, data=raster(np.frombuffer(data[at:], np.uint8)[None])[0].tobytes(), **fields)


def bmp_head(data: bytes, options: ReadOptions) -> Head:
    if data[:2] != b"BM" or len(data) < 18:
        raise ImageError("wrong magic")
    return _head(data, 14, struct.unpack_from("<I", data, 10)[0], options, FileFormat.BMP)


def dib_head(data: bytes, options: ReadOptions) -> Head:
    return _head(data, 0, None, options, FileFormat.DIB)


def _head(data: bytes, at: int, pixels: int | None, options: ReadOptions, kind: FileFormat) -> Head:
    if len(data) < at + 12:
        raise ImageError("the header breaks off")
    size = struct.unpack_from("<I", data, at)[0]
    compression = hres = vres = used = 0
    os2 = 16 <= size <= 64 and size not in (40, 52, 56)
    if size == 12:
        width, height, _, bpp = struct.unpack_from("<HHHH", data, at + 4)
    elif size >= 16:
        head = data[at : at + size].ljust(40, b"\0")
        if len(data) < at + min(size, 40):
            raise ImageError("the header breaks off")
        width, height, _, bpp = struct.unpack_from("<IIHH" if os2 else "<iiHH", head, 4)
        if size > 16:
            compression, _, hres, vres, used = struct.unpack_from("<IIiiI", head, 16)
    else:
        raise ImageError("unknown header size")
    top_down, height = height < 0, abs(height)
    if width <= 0 or height <= 0 or width * height > options.max_pixels:
        raise ImageError("width or height out of range")
    rle24 = bpp == 24 and compression == RLE24
    if os2 and compression == 3 or compression in (JPEG, PNG) and not rle24:
        raise Unsupported("compression")
    rle = rle24 or (bpp <= 8 and compression in (RLE8, RLE4, CMYKRLE8, CMYKRLE4))
    legal = {
        RGB: 0 < bpp <= 8 or bpp in (16, 24, 32), RLE8: bpp == 8, RLE4: bpp in (1, 2, 3, 4), BITFIELDS: bpp in (16, 32), ALPHABITFIELDS: bpp in (16, 32),
        RLE24: bpp == 24, CMYK: bpp == 32, CMYKRLE8: bpp == 8, CMYKRLE4: bpp == 4,
    }
    if not legal.get(compression, False):
        raise ImageError("this depth and compression don't go together")

    # Masks stand in the header from size 52 on, else behind it.
    masks = behind = 0
    read = at + min(size, 40)
    if compression in (BITFIELDS, ALPHABITFIELDS):
        n = 4 if compression == ALPHABITFIELDS else 3
        behind = 0 if size >= 52 else 4 * n
        if len(data) < at + 40 + 4 * n:
            raise ImageError("the masks break off")
        masks = list(struct.unpack_from(f"<{n}I", data, at + 40))
        read = at + 40 + 4 * n
        if n == 3 and size >= 56:
            masks.append(struct.unpack_from("<I", data, at + 52)[0])
            read = at + 56
        if len(masks) == 4 and not masks[3]:
            masks.pop()
    elif bpp == 16:
        masks = [0x7C00, 0x03E0, 0x001F]

    if bpp == 1 and not rle:
        comps, fmt = 1, Format.GRAY
    elif compression in (CMYK, CMYKRLE8, CMYKRLE4):
        comps, fmt = 4, Format.CMYK
    elif bpp == 32 and (not masks or len(masks) == 4) or masks and len(masks) == 4:
        comps, fmt = 4, Format.BGRA
    else:
        comps, fmt = 3, Format.BGR
    entry = 3 if size == 12 else 4
    palette_at = at + size + behind
    count = 0 if bpp > 8 else used or 1 << bpp
    if pixels is None:
        pixels = palette_at + count * entry
    if bpp <= 8:
        count = max(0, min(count, 1 << bpp, (min(pixels, len(data)) - palette_at) // entry))
    pad = 0 if rle else -width * comps % 4
    fields = {
        "format": fmt, "file_format": kind, "width": width, "height": height, "bytes_per_pixel": comps, "bits_per_pixel": 8 * comps, "bits_per_component": 8, "components": comps, "hres": hres, "vres": vres,
        "alpha_info": Alpha.LAST if fmt == Format.BGRA else Alpha.NONE, "row_pad": pad, "top_down": top_down, "color_space": ColorSpace.CMYK if fmt == Format.CMYK else ColorSpace.UNKNOWN,
    }
    indexed = not options.header_only and (bpp <= 8 and bpp != 1 or rle and bpp == 1)
    if indexed:
        table = np.zeros((1 << max(bpp, 1), comps), np.uint8)
        own = np.frombuffer(data, np.uint8, count * entry, palette_at).reshape(count, entry)
        table[:count, : min(comps, entry)] = own[:, :comps]

    def raster(raw: np.ndarray) -> np.ndarray:
        n, need = len(raw), (width * bpp + 31) // 32 * 4 * height
        if rle24:
            out = np.stack([run_lengths(r.tobytes(), width, height, 24) for r in raw])
        elif rle:
            out = table[np.stack([run_lengths(r.tobytes(), width, height, 4 if compression in (RLE4, CMYKRLE4) else 8) for r in raw]) & (len(table) - 1)]
        else:
            if raw.shape[1] < need - 3:
                raise ImageError("pixels are missing")
            rows = np.pad(raw, ((0, 0), (0, max(0, need - raw.shape[1]))))[:, :need].reshape(n * height, -1)
            if masks:
                words = rows[:, : width * bpp // 8].copy().view("<u2" if bpp == 16 else "<u4")
                out = np.stack([masked(words, m) for m in [*masks[2::-1], *masks[3:]]], axis=-1)
            elif bpp == 8:
                out = table[rows[:, :width]]
            elif bpp < 8:
                index = unpacked(rows, width, bpp)
                out = (index * 255).astype(np.uint8) if bpp == 1 else table[index]
            else:
                out = rows[:, : width * bpp // 8]
        return np.pad(out.reshape(n, height, width * comps), ((0, 0), (0, 0), (0, pad))).reshape(n, -1)

    return fields, max(read, pixels, palette_at + count * entry if bpp <= 8 else 0), pixels, raster


def masked(words: np.ndarray, mask: int) -> np.ndarray:
    """The component under a contiguous mask, scaled to 0..255 and truncated."""
    if not mask:
        return np.zeros(words.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    v = (words.astype(np.int64) & mask) >> shift
    return np.trunc(v * (255.0 / top)).astype(np.uint8) if top != 255 else v.astype(np.uint8)


def unpacked(rows: np.ndarray, width: int, bpp: int) -> np.ndarray:
    """Indexes of bpp bits, first pixel in the high bits. ceil(8/bpp) pixels come from a byte, the last one from what
    bits are left, with zeros for those that are missing."""
    per = -(-8 // bpp)
    wide = rows.astype(np.uint16)[:, :, None] << np.arange(0, per * bpp, bpp, dtype=np.uint16)
    return ((wide & 255) >> (8 - bpp)).reshape(len(rows), -1)[:, :width].astype(np.uint8)


def run_lengths(raw: bytes, width: int, height: int, bits: int) -> np.ndarray:
    """Indexes (or BGR pixels, for 24 bits) of run-length coded rows; gaps are zero. A run is clipped at its row's end."""
    total = width * height
    out = bytearray(total * (3 if bits == 24 else 1))
    size = 3 if bits == 24 else 1
    at, x, n = 0, 0, len(raw)  # x: pixels so far

    def put(pixels: bytes, count: int) -> None:
        nonlocal x
        room = min(count, width - x % width, total - x)
        out[x * size : (x + room) * size] = pixels[: room * size]
        x += room

    while at + 1 < n and x < total:
        count, code = raw[at], raw[at + 1]
        at += 2
        if count:
            if bits == 24:
                pixel = raw[at - 1 : at + 2]
                at += 2
                put(pixel.ljust(3, b"\0") * count, count)
            elif bits == 4:
                put((bytes([code >> 4, code & 15]) * ((count + 1) // 2))[:count], count)
            else:
                put(bytes([code]) * count, count)
        elif code == 0:
            x += -x % width  # at a row's start there is nothing left to fill
        elif code == 1:
            break
        elif code == 2:
            if at + 1 >= n:
                break
            x += raw[at] + width * raw[at + 1]
            at += 2
        else:
            length = (code + 1) // 2 if bits == 4 else code * size
            literal = raw[at : at + length]
            if bits == 4:
                own = np.frombuffer(literal, np.uint8)
                literal = np.stack([own >> 4, own & 15], 1).tobytes()[:code]
            put(literal.ljust(code * size, b"\0"), code)
            at += length + length % 2
    return np.frombuffer(bytes(out), np.uint8)
