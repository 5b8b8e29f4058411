"""Headers as column expressions: nothing is decoded, and columns that aren't selected aren't computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import i32le, u8, u16le, u32be, u32le


def png_header(b: Column) -> dict[str, Column]:
    ok = F.hex(F.substring(b, 1, 8)) == "89504E470D0A1A0A"
    at = {"width": u32be(b, 16).cast("int"), "height": u32be(b, 20).cast("int"), "depth": u8(b, 24), "color": u8(b, 25), "interlace": u8(b, 28)}
    return {"valid": ok & u8(b, 25).isin(0, 2, 3, 4, 6), **{k: F.when(ok, v) for k, v in at.items()}}


def qoi_header(b: Column) -> dict[str, Column]:
    ok = (F.hex(F.substring(b, 1, 4)) == "716F6966") & (F.octet_length(b) >= 22)
    at = {"width": u32be(b, 4).cast("int"), "height": u32be(b, 8).cast("int"), "channels": u8(b, 12), "linear": u8(b, 13)}
    return {"valid": ok & u8(b, 12).isin(3, 4), **{k: F.when(ok, v) for k, v in at.items()}}


def bmp_header(b: Column) -> dict[str, Column]:
    ok = F.hex(F.substring(b, 1, 2)) == "424D"
    core = u32le(b, 14) == 12
    at = {
        "width": F.when(core, u16le(b, 18)).otherwise(i32le(b, 18)), "height": F.when(core, u16le(b, 20)).otherwise(F.abs(i32le(b, 22))),
        "top_down": ~core & (i32le(b, 22) < 0), "depth": F.when(core, u16le(b, 24)).otherwise(u16le(b, 28)),
        "compression": F.when(core, F.lit(0)).otherwise(u32le(b, 30).cast("int")), "data_offset": u32le(b, 10),
    }
    return {"valid": ok, **{k: F.when(ok, v) for k, v in at.items()}}


def tga_header(b: Column) -> dict[str, Column]:
    flags = u8(b, 17)
    side = F.when(flags.bitwiseAND(F.lit(8)) != 0, F.lit(8)).otherwise(F.lit(4))
    up = F.when(flags.bitwiseAND(F.lit(16)) != 0, F.lit(0)).otherwise(F.lit(2))
    comps = F.when(u8(b, 16) == 8, 1).when(u8(b, 16).isin(15, 16), 2).when(u8(b, 16) == 24, 3).when(u8(b, 16) == 32, 4)
    return {"valid": comps.isNotNull() & u8(b, 2).isin(1, 2, 3, 9, 10, 11), "width": u16le(b, 12), "height": u16le(b, 14), "components": comps, "orientation": side.bitwiseOR(up)}


#: What separates the numbers of a PNM header: space, and comments up to the end of their line.
GAP = r"(?:[ \t\r\n\x0B\x0C]|#[^\r\n]*(?:[\r\n]|$))+"


def _latin(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def pnm_header(b: Column) -> dict[str, Column]:
    """P1 to P6: width, height and maxval (null for P1 and P4). Comments may be of any length."""
    text = _latin(b)
    got = [F.regexp_extract(text, rf"^P[1-6]{GAP}(\d+){GAP}(\d+)(?:{GAP}(\d+))?", k) for k in (1, 2, 3)]
    number = [F.when(x != "", x.cast("int")) for x in got]
    kind = F.substring(b, 2, 1).cast("string")
    return {"valid": number[0].isNotNull() & number[1].isNotNull(), "width": number[0], "height": number[1], "maxval": F.when(~kind.isin("1", "4"), number[2])}


def pfm_header(b: Column) -> dict[str, Column]:
    """PF, Pf and PF4: width, height, components, and whether samples are little-endian."""
    text = _latin(b)
    kind, width, height, scale = (F.regexp_extract(text, r"^(PF4|PF|Pf)\s+(\d+)\s+(\d+)\s+([-+]?[0-9.]+)", k) for k in (1, 2, 3, 4))
    ok = kind != ""
    at = {"width": width.cast("int"), "height": height.cast("int"), "components": F.when(kind == "PF4", 4).when(kind == "PF", 3).otherwise(1), "little": scale.startswith("-")}
    return {"valid": ok, **{k: F.when(ok, v) for k, v in at.items()}}


def pam_header(b: Column) -> dict[str, Column]:
    """P7: width, height, depth, maxval and tuple type, in any order before ENDHDR."""
    head = F.regexp_extract(_latin(b), r"^P7[\r\n]([\s\S]*?)ENDHDR[\r\n]", 1)
    number = {n: F.regexp_extract(head, rf"(?m)^[ \t]*{n.upper()}[ \t]+(\d+)", 1) for n in ("width", "height", "depth", "maxval")}
    kind = F.regexp_extract(head, r"(?m)^[ \t]*TUPLTYPE[ \t]+([^\s]+)", 1)
    at = {n: F.when(v != "", v.cast("int")) for n, v in number.items()}
    valid = (head != "") & at["width"].isNotNull() & at["height"].isNotNull() & at["depth"].isNotNull() & at["maxval"].isNotNull()
    return {"valid": valid, **at, "tuple_type": F.when(kind != "", kind)}


def jpeg_kind(b: Column) -> Column:
    """jfif or exif, by the first segment of a JPEG; null for other content."""
    head = F.hex(F.substring(b, 1, 4))
    return F.when(head == "FFD8FFE0", F.lit("jfif")).when(head == "FFD8FFE1", F.lit("exif"))


def is_app_marker(marker: Column) -> Column:
    """Whether the second byte of a marker names an application segment."""
    return marker.bitwiseAND(F.lit(0xF0)) == 0xE0


def is_frame_marker(marker: Column) -> Column:
    """Whether it starts a frame: DHT, JPG and DAC share the range, and don't."""
    return (marker.bitwiseAND(F.lit(0xF0)) == 0xC0) & ~marker.isin(0xC4, 0xC8, 0xCC)
