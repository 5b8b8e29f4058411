"""PNG: chunks, inflate, unfiltering, Adam7, palettes and transparency. CRCs aren't verified."""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np

from ..options import ReadOptions
from ..schema import Alpha, ByteOrder, ColorSpace, FileFormat, Format, ImageError, record

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: For each pass of Adam7: first column, first row, column step, row step.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
_KINDS = {0: (1, Format.GRAY), 2: (3, Format.RGB), 3: (1, Format.RGB), 4: (2, Format.GRAY_ALPHA), 6: (4, Format.RGBA)}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, content) up to IEND."""
    at = 8
    while True:
        if at + 8 > len(data):
            raise ImageError("the chunks break off")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            if not (kind == b"IEND" and size == 0):
                raise ImageError("a chunk breaks off")
        yield kind, data[at + 8 : at + 8 + size]
        if kind == b"IEND":
            return
        at += 12 + size


def _sized(kind: bytes, body: bytes, size: int) -> bytes:
    if len(body) != size:
        raise ImageError(f"{kind.decode('latin-1')} has a wrong length")
    return body


def paeth_row(raw: np.ndarray, above: np.ndarray, bpp: int) -> bytearray:
    out, up = bytearray(raw.tobytes()), above.tobytes()
    for x in range(min(bpp, len(out))):
        out[x] = (out[x] + up[x]) & 255
    for x in range(bpp, len(out)):
        a, b, c = out[x - bpp], up[x], up[x - bpp]
        pa, pb = abs(b - c), abs(a - c)
        pc = abs(a + b - 2 * c)
        out[x] = (out[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return out


def average_row(raw: np.ndarray, above: np.ndarray, bpp: int) -> bytearray:
    out, up = bytearray(raw.tobytes()), above.tobytes()
    for x in range(min(bpp, len(out))):
        out[x] = (out[x] + (up[x] >> 1)) & 255
    for x in range(bpp, len(out)):
        out[x] = (out[x] + ((out[x - bpp] + up[x]) >> 1)) & 255
    return out


def sub_row(raw: np.ndarray, bpp: int) -> np.ndarray:
    """A running sum of each channel, modulo 256."""
    padded = np.zeros(-(-len(raw) // bpp) * bpp, np.uint8)
    padded[: len(raw)] = raw
    return np.cumsum(padded.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[: len(raw)]


#: Rows that are unfiltered at once, so that memory is bounded, and the bytes of averaged or Paeth rows that a diagonal must
#: stand for before going by diagonals takes less time than byte by byte.
BAND, WORTH = 256, 180


def _by_diagonals(lines: np.ndarray, filters: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Rows with any filters. A pixel needs its left, upper and upper left ones, so all pixels of an anti-diagonal are
    worked out at once, whatever their rows' filters."""
    n, p = len(lines), lines.shape[1] // bpp
    rows = np.zeros((n + 1, p + n + 1, bpp), np.int16)
    rows[0, :p] = above.reshape(p, bpp)
    rows[1:, :p] = lines.reshape(n, p, bpp)
    # Row y moves right by y, so that columns are diagonals; two of zeros come first.
    skewed = rows.reshape(-1, bpp)[: (n + 1) * (p + n)].reshape(n + 1, p + n, bpp)
    out = np.zeros((p + n + 2, n + 1, bpp), np.int16)
    out[2:] = skewed.transpose(1, 0, 2)
    kinds = np.concatenate([[0], filters]).astype(np.int16)[:, None]
    masks = {k: (kinds == k).astype(np.int16) for k in (1, 2, 3, 4) if (filters == k).any()}
    for d in range(1, p + n):
        lo, hi = max(1, d - p + 1), min(n, d) + 1
        a, b, c = out[d + 1, lo:hi], out[d + 1, lo - 1 : hi - 1], out[d, lo - 1 : hi - 1]
        own = out[d + 2, lo:hi]
        for k, mask in masks.items():
            if k == 4:
                ac, bc = a - c, b - c
                pa, pb, pc = np.abs(bc), np.abs(ac), np.abs(ac + bc)
                guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
            else:
                guess = a if k == 1 else b if k == 2 else (a + b) >> 1
            own += guess if len(masks) == 1 and (filters == k).all() else guess * mask[lo:hi]
        own &= 255
    width = p + n
    back = np.zeros((n + 1, width + 1, bpp), np.uint8)
    back.reshape(-1, bpp)[: (n + 1) * width] = out[2:].transpose(1, 0, 2).reshape(-1, bpp)
    return back[1:, :p].reshape(n, -1)


def _by_rows(lines: np.ndarray, filters: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Row by row; runs of UP rows are summed at once."""
    height, row = lines.shape
    out = np.zeros((height + 1, row), np.uint8)
    out[0] = above
    y = 0
    while y < height:
        kind = filters[y]
        if kind in (0, 2):
            end = y + 1
            while end < height and filters[end] == kind:
                end += 1
            if kind == 0:
                out[y + 1 : end + 1] = lines[y:end]
            else:
                out[y + 1 : end + 1] = np.cumsum(np.concatenate([out[y : y + 1], lines[y:end]]), axis=0, dtype=np.uint8)[1:]
            y = end
            continue
        if kind == 1:
            out[y + 1] = sub_row(lines[y], bpp)
        else:
            made = average_row(lines[y], out[y], bpp) if kind == 3 else paeth_row(lines[y], out[y], bpp)
            out[y + 1] = np.frombuffer(made, np.uint8)
        y += 1
    return out[1:]


def unfiltered(raw: bytes, height: int, row: int, bpp: int) -> np.ndarray:
    """Rows of bytes from rows that each stand behind a filter byte."""
    if len(raw) < height * (row + 1):
        raise ImageError("image data is missing")
    lines = np.frombuffer(raw, np.uint8, height * (row + 1)).reshape(height, row + 1)
    filters, lines = lines[:, 0], lines[:, 1:]
    if filters.max(initial=0) > 4:
        raise ImageError("unknown filter")
    out, above = np.empty((height, row), np.uint8), np.zeros(row, np.uint8)
    for y in range(0, height, BAND):
        own = filters[y : y + BAND]
        worth = row % bpp == 0 and np.count_nonzero(own >= 3) * row > WORTH * (row // bpp + len(own))
        part = out[y : y + BAND] = (_by_diagonals if worth else _by_rows)(lines[y : y + BAND], own, above, bpp)
        above = part[-1]
    return out


def _samples(rows: np.ndarray, width: int, comps: int, depth: int) -> np.ndarray:
    """(height, width, comps * bytes of a sample), with samples below 8 bits unpacked, unscaled."""
    if depth >= 8:
        return rows.reshape(len(rows), width, -1)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8))[:, : width * comps].reshape(len(rows), width, comps).astype(np.uint8)


def _packed(samples: np.ndarray, depth: int) -> np.ndarray:
    """The reverse for samples below 8 bits: rows start on a byte."""
    flat = samples.reshape(len(samples), -1)
    bits = (flat[:, :, None] >> np.arange(depth)[::-1].astype(np.uint8)) & 1
    return np.packbits(bits.reshape(len(samples), -1), axis=1)


def _adam7(raw: bytes, width: int, height: int, comps: int, depth: int, bpp: int) -> np.ndarray:
    out = np.zeros((height, width, comps * max(1, depth // 8)), np.uint8)
    at = 0
    for x, y, dx, dy in ADAM7:
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w <= 0 or h <= 0:
            continue
        row = (w * comps * depth + 7) // 8
        out[y::dy, x::dx] = _samples(unfiltered(raw[at:], h, row, bpp), w, comps, depth)
        at += h * (row + 1)
    return out


#: A profile may be so many times larger than its compressed form, or so many bytes.
ICC_TIMES, ICC_BYTES = 4, 1 << 20


def _profile(packed: bytes) -> bytes:
    unpacker = zlib.decompressobj()
    out = unpacker.decompress(packed, max(ICC_TIMES * len(packed), ICC_BYTES))
    if not unpacker.eof:
        raise ImageError("iCCP breaks off or expands too far")
    return out


def _order(options: ReadOptions) -> ByteOrder:
    return {ByteOrder.HOST: ByteOrder.LITTLE if sys.byteorder == "little" else ByteOrder.BIG}.get(options.byte_order, options.byte_order)


def png(data: bytes, options: ReadOptions) -> dict:
    if data[:8] != SIGNATURE:
        raise ImageError("wrong signature")
    head: tuple | None = None
    fields: dict = {"file_format": FileFormat.PNG, "cgbi": False}
    parts: list[bytes] = []
    palette = alphas = None
    try:
        for kind, body in chunks(data):
            if head is None and kind not in (b"IHDR", b"CgBI"):
                raise ImageError("IHDR isn't first")
            match kind:
                case b"CgBI":
                    fields["cgbi"] = True
                case b"IHDR":
                    width, height, depth, color, method, filtering, interlace = head = struct.unpack(">IIBBBBB", _sized(kind, body, 13))
                    if color not in _KINDS or depth not in _DEPTHS[color] or method or filtering or interlace > 1:
                        raise ImageError("IHDR out of range")
                    if not 0 < width < 1 << 31 or not 0 < height < 1 << 31 or width * height > options.max_pixels:
                        raise ImageError("width or height out of range")
                    comps, fmt = _KINDS[color]
                case b"PLTE":
                    if not body or len(body) % 3 or len(body) > 768:
                        raise ImageError("PLTE has a wrong length")
                    if color == 3:
                        palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
                        fields["palette"] = {"bytes": body, "len": len(body), "count": len(palette)}
                case b"tRNS" if color in (4, 6):
                    pass  # the pixels have alpha already
                case b"tRNS" if color == 3:
                    if palette is None or len(body) > len(palette):
                        raise ImageError("tRNS is longer than the palette")
                    alphas = np.full(len(palette), 255, np.uint8)
                    alphas[: len(body)] = np.frombuffer(body, np.uint8)
                    fields["trns"] = {"alpha": body}
                case b"tRNS":
                    low = (1 << depth) - 1
                    values = struct.unpack(">H" if color == 0 else ">HHH", _sized(kind, body, 2 if color == 0 else 6))
                    fields["trns"] = dict(zip(("gray",) if color == 0 else ("red", "green", "blue"), (v & low for v in values), strict=True))
                case b"bKGD":
                    if color == 3:
                        fields["background"] = {"index": _sized(kind, body, 1)[0]}
                    else:
                        values = struct.unpack(">H" if color in (0, 4) else ">HHH", _sized(kind, body, 2 if color in (0, 4) else 6))
                        fields["background"] = dict(zip(("gray",) if color in (0, 4) else ("red", "green", "blue"), values, strict=True))
                case b"gAMA":
                    fields["gamma"] = struct.unpack(">I", _sized(kind, body, 4))[0] / 100000.0
                case b"cHRM":
                    values = struct.unpack(">8I", _sized(kind, body, 32))
                    fields["chroma"] = {f"{c}_{a}": v / 100000.0 for (c, a), v in zip(((c, a) for c in ("white", "red", "green", "blue") for a in "xy"), values, strict=True)}
                case b"sRGB":
                    fields["srgb_intent"], fields["color_space"] = _sized(kind, body, 1)[0], ColorSpace.SRGB
                case b"iCCP":
                    _, _, rest = body.partition(b"\0")
                    if not rest or rest[0]:
                        raise ImageError("iCCP has an unknown method")
                    fields["icc"] = _profile(rest[1:])
                case b"pHYs":
                    fields["phys"] = dict(zip(("x", "y", "unit"), struct.unpack(">IIB", _sized(kind, body, 9)), strict=True))
                case b"tIME":
                    fields["time"] = dict(zip(("year", "month", "day", "hour", "minute", "second"), struct.unpack(">HBBBBB", _sized(kind, body, 7)), strict=True))
                case b"IDAT":
                    if not options.header_only:
                        parts.append(body)
        if head is None:
            raise ImageError("IHDR is missing")
        if color == 3 and palette is None:
            raise ImageError("PLTE is missing")
        transparent = "trns" in fields
        shown = Alpha.LAST if color in (4, 6) or transparent else Alpha.NONE
        if color == 0 and transparent:
            fmt = Format.GRAY_ALPHA  # the label only: pixels stay gray
        size = max(1, depth // 8)
        swap = depth == 16 and _order(options) == ByteOrder.LITTLE
        fields |= {
            "format": fmt, "width": width, "height": height, "bytes_per_pixel": comps * size, "bits_per_pixel": comps * depth, "bits_per_component": depth, "components": comps, "alpha_info": shown,
            "byte_order": options.byte_order if depth == 16 else ByteOrder.HOST,
        }
        expand = palette is not None and (not options.supports_palette or alphas is not None)
        if expand or color == 2 and transparent:
            comps_out = 3 if expand and alphas is None else 4
            fields |= {"format": Format.RGB if comps_out == 3 else Format.RGBA, "components": comps_out, "bytes_per_pixel": comps_out * size, "bits_per_pixel": comps_out * max(8, depth), "bits_per_component": max(8, depth)}
        if options.header_only:
            return record("png", **fields)

        bpp = max(1, comps * depth // 8)
        unpacker = zlib.decompressobj()
        row = (width * comps * depth + 7) // 8
        if interlace:
            need = sum(-(-(height - y) // dy) * ((-(-(width - x) // dx) * comps * depth + 7) // 8 + 1) for x, y, dx, dy in ADAM7 if width > x and height > y)
        else:
            need = height * (row + 1)
        raw = unpacker.decompress(b"".join(parts), need)
    except (zlib.error, struct.error) as e:
        raise ImageError(str(e)) from e
    if interlace:
        samples = _adam7(raw, width, height, comps, depth, bpp)
        rows = samples.reshape(height, -1) if depth >= 8 else _packed(samples, depth)
    else:
        rows = unfiltered(raw, height, row, bpp)
    return record("png", data=_shown(rows, width, depth, palette if expand else None, alphas, fields["trns"] if color == 2 and transparent else None, swap).tobytes(), **fields)


def _shown(rows: np.ndarray, width: int, depth: int, palette: np.ndarray | None, alphas: np.ndarray | None, clear: dict | None, swap: bool) -> np.ndarray:
    """Rows of samples as the record has them. palette: to expand to, clear: the colour that gets alpha 0."""
    size = max(1, depth // 8)
    if palette is not None:
        index = _samples(rows, width, 1, depth)[:, :, 0]
        if index.max(initial=0) >= len(palette):
            raise ImageError("an index is beyond the palette")
        table = palette if alphas is None else np.column_stack([palette, alphas])
        rows = table[index]
    elif clear is not None:
        px = rows.reshape(len(rows), width, 3, size)
        key = np.array([[v >> 8 * (size - 1 - k) & 255 for k in range(size)] for v in (clear[c] for c in ("red", "green", "blue"))], np.uint8)
        alpha = np.where((px == key).all(axis=(2, 3)), 0, 255).astype(np.uint8)[:, :, None, None].repeat(size, 3)
        rows = np.concatenate([px, alpha], axis=2)
    if swap:
        rows = np.ascontiguousarray(rows).reshape(-1, 2)[:, ::-1]
    return np.ascontiguousarray(rows)


def unfiltered_many(lines: np.ndarray, filters: np.ndarray, bpp: int) -> np.ndarray:
    """Like unfiltered, for (files, rows, bytes) and (files, rows) filters: a pixel of every file at a time."""
    files, height, row = lines.shape
    p = row // bpp
    out = np.zeros((height + 1, p + 1, files, bpp), np.int16)
    out[1:, 1:] = lines.reshape(files, height, p, bpp).transpose(1, 2, 0, 3)
    for y in range(1, height + 1):
        kinds = filters[:, y - 1]
        own = {k: (kinds == k)[:, None] for k in np.unique(kinds).tolist() if k}
        whole = len(own) == 1 and next(iter(own.values())).all()
        for x in range(1, p + 1) if own else ():
            a, b, c = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
            for k, mask in own.items():
                if k == 4:
                    ac, bc = a - c, b - c
                    pa, pb, pc = np.abs(bc), np.abs(ac), np.abs(ac + bc)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                else:
                    guess = a if k == 1 else b if k == 2 else (a + b) >> 1
                out[y, x] += guess if whole else guess * mask
            out[y, x] &= 255
    return out[1:, 1:].transpose(2, 0, 1, 3).reshape(files, height, row).astype(np.uint8)


def _own_fields(kind: bytes, body: np.ndarray, color: int, depth: int) -> tuple[str, list]:
    """The field that a chunk makes, for the chunks (files, bytes) of one kind and size."""
    wide = lambda t: np.ascontiguousarray(body).view(t).tolist()
    dicts = lambda names, rows: [dict(zip(names, r, strict=True)) for r in rows]
    match kind:
        case b"gAMA":
            return "gamma", [r[0] / 100000.0 for r in wide(">u4")]
        case b"cHRM":
            names = [f"{c}_{a}" for c in ("white", "red", "green", "blue") for a in "xy"]
            return "chroma", dicts(names, (np.ascontiguousarray(body).view(">u4") / 100000.0).tolist())
        case b"sRGB":
            return "srgb_intent", body[:, 0].tolist()
        case b"iCCP":
            out = []
            for packed in body:
                _, _, rest = packed.tobytes().partition(b"\0")
                if not rest or rest[0]:
                    raise ImageError("iCCP has an unknown method")
                out.append(_profile(rest[1:]))
            return "icc", out
        case b"pHYs":
            return "phys", [{"x": x, "y": y, "unit": unit} for (x, y), unit in zip(np.ascontiguousarray(body[:, :8]).view(">u4").tolist(), body[:, 8].tolist(), strict=True)]
        case b"tIME":
            years = np.ascontiguousarray(body[:, :2]).view(">u2")[:, 0].tolist()
            return "time", dicts(("year", "month", "day", "hour", "minute", "second"), ((y, *r) for y, r in zip(years, body[:, 2:].tolist(), strict=True)))
        case b"tRNS":
            return "trns", [{"gray": r[0] & ((1 << depth) - 1)} for r in wide(">u2")]
    if color == 3:
        return "background", [{"index": k} for k in body[:, 0].tolist()]
    return "background", dicts(("gray",) if color in (0, 4) else ("red", "green", "blue"), wide(">u2"))


def _data_parts(data: bytes, at: int) -> list[bytes] | None:
    """The image data, if nothing but it stands between at and IEND."""
    parts, n = [], len(data)
    while at + 8 <= n:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IEND":
            return parts if at + 12 + size <= n or not size else None
        if kind != b"IDAT" or at + 12 + size > n:
            return None
        parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    return None


class Layout:
    """Where the chunks of a file stand up to its image data, and what other files must share to be decoded with it."""

    def __init__(self, data: bytes):
        self.data, self.chunks, at = data, [], 8
        for kind, body in chunks(data):
            if kind in (b"IDAT", b"IEND"):
                break
            self.chunks.append((at, kind, len(body)))
            at += 12 + len(body)
        self.at = at
        _, _, self.depth, self.color, _, _, self.interlace = struct.unpack_from(">IIBBBBB", data, next(a for a, kind, _ in self.chunks if kind == b"IHDR") + 8)

    def own(self, kind: bytes) -> bool:
        """Whether files may differ in such a chunk: the record takes it over as it is."""
        return kind in (b"gAMA", b"cHRM", b"sRGB", b"iCCP", b"pHYs", b"tIME", b"bKGD") or kind == b"tRNS" and self.color == 0

    def heads(self, files: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(f[: self.at] for f in files), np.uint8).reshape(len(files), self.at)

    def shared(self, files: list[bytes]) -> np.ndarray:
        """Which files are laid out alike and equal in all that isn't their own; checksums aren't looked at."""
        same = np.ones(self.at, bool)
        for a, kind, size in self.chunks:
            same[a + 8 : a + 8 + size] = not self.own(kind)
            same[a + 8 + size : a + 12 + size] = False
        long = np.array([len(f) >= self.at for f in files])
        out = np.zeros(len(files), bool)
        out[long] = (self.heads([f for f in files if len(f) >= self.at])[:, same] == np.frombuffer(self.data, np.uint8, self.at)[same]).all(axis=1)
        return out


def png_many(files: list[bytes], layout: Layout, first: dict, options: ReadOptions) -> tuple[list[int], dict]:
    """The places of files that can be decoded together, and what each has besides the first's record. They share the layout."""
    data = [_data_parts(f, layout.at) for f in files]
    places = [k for k, parts in enumerate(data) if parts is not None]
    heads, color, depth = layout.heads([files[k] for k in places]), layout.color, layout.depth
    fields = dict(_own_fields(kind, heads[:, a + 8 : a + 8 + size], color, depth) for a, kind, size in layout.chunks if layout.own(kind))
    if layout.interlace and not options.header_only:
        return [], {}
    parts = [b"".join(data[k]) for k in places]
    if options.header_only or not places:
        return places, fields
    width, height = first["width"], first["height"]
    comps = _KINDS[color][0]
    row = (width * comps * depth + 7) // 8
    need = height * (row + 1)
    raw = b"".join(zlib.decompressobj().decompress(x, need) for x in parts)
    if len(raw) != need * len(parts):
        raise ImageError("image data is missing")
    lines = np.frombuffer(raw, np.uint8).reshape(len(parts), height, row + 1)
    if lines[:, :, 0].max() > 4:
        raise ImageError("unknown filter")
    rows = unfiltered_many(lines[:, :, 1:], lines[:, :, 0], max(1, comps * depth // 8)).reshape(-1, row)
    palette = alphas = None
    if color == 3 and (not options.supports_palette or first["trns"] is not None):
        palette = np.frombuffer(first["palette"]["bytes"], np.uint8).reshape(-1, 3)
        if first["trns"] is not None:
            alphas = np.full(len(palette), 255, np.uint8)
            alphas[: len(first["trns"]["alpha"])] = np.frombuffer(first["trns"]["alpha"], np.uint8)
    made = _shown(rows, width, depth, palette, alphas, first["trns"] if color == 2 else None, depth == 16 and _order(options) == ByteOrder.LITTLE)
    return places, fields | {"data": made.reshape(len(parts), -1)}
