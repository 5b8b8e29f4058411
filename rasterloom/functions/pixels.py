"""Pixel kernels as column expressions: they stay in the JVM, fold, and take part in filters and joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COMPONENTS, Format


def clamp(v: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Truncated toward zero, clamped to 0..255."""
    y, b, r = y.cast("double"), cb.cast("double") - 128, cr.cast("double") - 128
    return tuple(clamp(v.cast("int"), 0, 255) for v in (y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b))


def masked_component(pixel: Column, mask: int) -> Column:
    """The component under a contiguous mask, scaled to 0..255 and truncated."""
    if not mask:
        return F.lit(0)
    shift = (mask & -mask).bit_length() - 1
    v = F.shiftright(pixel.cast("long").bitwiseAND(F.lit(mask).cast("long")), shift)
    return (v * F.lit(255.0 / (mask >> shift))).cast("int")


def trailing_zeros(m: Column) -> Column:
    """Of a long; 64 for 0."""
    return F.bit_count(m.bitwiseAND(-m) - 1)


def first_set(m: Column) -> Column:
    """The place of the lowest set bit, from 1; 0 for 0."""
    return F.when(m == 0, F.lit(0)).otherwise(trailing_zeros(m) + 1)


def leading_zeros32(m: Column) -> Column:
    """Of the low 32 bits of a long; 32 for 0."""
    low = m.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.when(low == 0, F.lit(32)).otherwise(32 - F.length(F.bin(low)))


def bit(v: Column, at: Column | int) -> Column:
    return F.getbit(v, F.lit(at) if isinstance(at, int) else at)


def packed_sample(byte: Column, x: Column, depth: int) -> Column:
    """Sample x of a row whose byte is given; first sample in the high bits."""
    per = 8 // depth
    return F.shiftright(byte, 8 - depth).bitwiseAND(F.lit((1 << depth) - 1)) if per == 1 else F.call_function("shiftright", byte, (8 - depth * (F.pmod(x, F.lit(per)) + 1)).cast("int")).bitwiseAND(F.lit((1 << depth) - 1))


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Of left, above and upper left the nearest to left + above - upper left."""
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def key_alpha(r: Column, g: Column, b: Column, key: tuple[Column, Column, Column]) -> Column:
    """0 where a pixel has the key's colour, else 255."""
    return F.when((r == key[0]) & (g == key[1]) & (b == key[2]), F.lit(0)).otherwise(F.lit(255))


def quantised(v: Column) -> Column:
    """A float sample to 0..255 in float32, truncated."""
    one = F.least(F.greatest(v.cast("float"), F.lit(0).cast("float")), F.lit(1).cast("float"))
    return (one * F.lit(255).cast("float")).cast("float").cast("int")


def extended(v: Column, size: Column) -> Column:
    """A JPEG difference of `size` bits with its sign: v below 2**(size-1) is negative."""
    half = F.call_function("shiftleft", F.lit(1), (size - 1).cast("int"))
    return F.when(size == 0, F.lit(0)).when(v < half, v - 2 * half + 1).otherwise(v)


def swapped16(v: Column) -> Column:
    return F.shiftleft(v.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(v, 8).bitwiseAND(F.lit(255)))


def swapped32(v: Column) -> Column:
    """The four bytes of a long's low 32 bits, turned round; a long."""
    piece = lambda shift: F.shiftright(v, shift).bitwiseAND(F.lit(255).cast("long"))
    return F.shiftleft(piece(0), 24).bitwiseOR(F.shiftleft(piece(8), 16)).bitwiseOR(F.shiftleft(piece(16), 8)).bitwiseOR(piece(24))


def swapped64(v: Column) -> Column:
    """The eight bytes of a long, turned round."""
    low, high = v.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(v, 32)
    return F.shiftleft(swapped32(low), 32).bitwiseOR(swapped32(high))


def display_components(fmt: Column) -> Column:
    """Components that a display needs for a format; null for those that can't be shown."""
    table = F.create_map(*[F.lit(int(x)) for kv in COMPONENTS.items() for x in kv])
    return F.try_element_at(table, fmt)


def row_stride(bits_per_pixel: Column, width: Column, row_pad: Column) -> Column:
    """Bytes of a row, pad and all."""
    return F.floor((bits_per_pixel.cast("long") * width + 7) / 8).cast("long") + row_pad


def fit(image_w: Column, image_h: Column, box: tuple[Column, Column], most: tuple[Column, Column], keep_aspect: bool = True, client: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """x, y, w, h of an image drawn in a box, no larger than `most`, its aspect kept, centred in client. Ratios are float32."""
    aspect = (image_h.cast("float") / image_w.cast("float")).cast("float")
    w, h = F.least(box[0], most[0]), F.least(box[1], most[1])
    if keep_aspect:
        high = (w.cast("float") * aspect).cast("float").cast("int")
        narrow = (h.cast("float").cast("double") / aspect.cast("double")).cast("float").cast("int")
        w, h = F.when(h < high, narrow).otherwise(w), F.least(h, high)
    zero = F.lit(0)
    x, y = (((c - v) * F.lit(0.5)).cast("int") for c, v in zip(client, (w, h), strict=True)) if client else (zero, zero)
    return {"x": x, "y": y, "w": w, "h": h}


#: Formats whose first and third component change places.
SWAPS = {Format.BGR: Format.RGB, Format.RGB: Format.BGR, Format.BGRA: Format.RGBA, Format.RGBA: Format.BGRA}


def swapped_channel(c: Column, comps: int) -> Column:
    """The channel's place when the first and third change places."""
    return F.when(c == 0, F.lit(2)).when(c == 2, F.lit(0)).otherwise(c) if comps >= 3 else c
