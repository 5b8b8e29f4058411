"""The image record: enums, status codes, and the Spark type of a decoded file."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class Status(IntEnum):
    OK = 0
    NOOP = 1
    ERROR = -1
    NOT_FOUND = -1000
    NO_MEMORY = -1001
    NO_PERMISSION = -1002
    BAD_FILE = -1003
    UNSUPPORTED = -2


class Format(IntEnum):
    NONE = 0
    BLACKWHITE = 1
    GRAY = 2
    RGB = 3
    RGB0 = 4
    RGBA = 5
    ARGB = 6
    BGR = 7
    BGR0 = 8
    BGRA = 9
    ABGR = 10
    CMYK = 11
    YCBCR = 12
    GRAY_ALPHA = 13


#: Components that a display needs for a format; formats that aren't here can't be shown.
COMPONENTS = {
    Format.RGB: 3, Format.BGR: 3, Format.YCBCR: 3, Format.RGBA: 4, Format.ARGB: 4, Format.RGB0: 4, Format.BGRA: 4,
    Format.ABGR: 4, Format.BGR0: 4, Format.CMYK: 4, Format.GRAY: 1, Format.BLACKWHITE: 1, Format.GRAY_ALPHA: 2,
}


class Orientation(IntEnum):
    UP = 0
    DOWN = 2
    LEFT = 4
    RIGHT = 8


class Alpha(IntEnum):
    NONE = 0
    PREMULTIPLIED_LAST = 1
    PREMULTIPLIED_FIRST = 2
    LAST = 3
    FIRST = 4
    SKIP_LAST = 5
    SKIP_FIRST = 6
    ONLY = 7


class ByteOrder(IntEnum):
    HOST = 0
    LITTLE = 1
    BIG = 2
    ANY = 3


class ColorSpace(IntEnum):
    UNKNOWN = 0
    SRGB = 1
    LINEAR = 2
    GRAY = 3
    CMYK = 4
    P3 = 5


class FileFormat(IntEnum):
    NONE = 0
    PNG = 1
    JPEG = 2
    BMP = 3
    DIB = 4
    TGA = 5
    QOI = 6
    PBM = 7
    PGM = 8
    PPM = 9
    PFM = 10
    PAM = 11


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_I, _L, _D, _B, _S = T.IntegerType(), T.LongType(), T.DoubleType(), T.BinaryType(), T.StringType()

#: Everything but the samples and sub-records.
HEADER = _struct(
    status=_I, reason=_S, codec=_S, format=_I, format_name=_S, file_format=_I, width=_I, height=_I, bytes_per_pixel=_I, bits_per_pixel=_I,
    bits_per_component=_I, components=_I, hres=_I, vres=_I, orientation=_I, alpha_info=_I, byte_order=_I, color_space=_I, row_pad=_I, top_down=T.BooleanType(),
)
PALETTE = _struct(bytes=_B, len=_I, count=_I)
TRNS = _struct(gray=_I, red=_I, green=_I, blue=_I, alpha=_B)
BACKGROUND = _struct(gray=_I, red=_I, green=_I, blue=_I, index=_I)
CHROMA = _struct(**{f"{c}_{a}": _D for c in ("white", "red", "green", "blue") for a in "xy"})
PHYS = _struct(x=_L, y=_L, unit=_I)
TIME = _struct(year=_I, month=_I, day=_I, hour=_I, minute=_I, second=_I)
IMAGE = T.StructType([
    *HEADER.fields,
    *_struct(
        data=_B, len=_L, palette=PALETTE, trns=TRNS, background=BACKGROUND, gamma=_D, chroma=CHROMA, srgb_intent=_I, icc=_B, phys=PHYS, time=TIME,
        comments=T.ArrayType(_S), cgbi=T.BooleanType(),
    ).fields,
])
FIELDS = IMAGE.fieldNames()


class ImageError(Exception):
    """Content that isn't a legal image."""


class Unsupported(ImageError):
    """A legal image of a kind that isn't covered."""


def record(codec: str, **fields) -> dict:
    """An image record with defaults for what isn't given: zero for the header's numbers, null for sub-records."""
    out: dict = {f.name: 0 if isinstance(f.dataType, T.IntegerType) else None for f in HEADER.fields}
    out |= {n: None for n in FIELDS if n not in out}
    out |= {"codec": codec, "top_down": True, **fields, "srgb_intent": fields.get("srgb_intent")}
    out["format_name"] = Format(out["format"]).name
    out["len"] = len(out["data"]) if out["data"] is not None else 0
    return {k: int(v) if isinstance(v, IntEnum) else v for k, v in out.items()}


def failure(codec: str | None, status: Status, reason: str) -> dict:
    out: dict = {n: None for n in FIELDS}
    return out | {"codec": codec, "status": int(status), "reason": reason}
