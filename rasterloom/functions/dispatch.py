"""From a file name to its codec, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slots of the extension hash. Extensions that aren't listed may hit one too: no name is compared.
SLOTS = {
    0x06: "dib", 0x1F: "ppm", 0x30: "tga", 0x3C: "pbm", 0x54: "heic", 0x58: "jp2", 0x64: "tga", 0x68: "pgm", 0x79: "bmp", 0x7A: "jxl",
    0x99: "qoi", 0x9D: "tga", 0xA9: "png", 0xEA: "tga", 0xF0: "pam", 0xF7: "jpeg", 0xFB: "pfm", 0xFC: "jpeg",
}


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path; null without a dot."""
    return F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1))


def extension_hash(ext: Column) -> Column:
    """FNV-1a over the first four characters, in lower case, folded to 8 bits."""
    codes = F.transform(F.split(F.substring(ext, 1, 4), ""), lambda c: F.ascii(c).cast("long"))
    codes = F.filter(codes, lambda c: c > 0)
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: a.bitwiseXOR(c.bitwiseOR(F.lit(32).cast("long"))) * F.lit(16777619) % F.lit(4294967296))
    return h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(F.lit(255).cast("long")).cast("int")


def codec(path: Column) -> Column:
    """The codec of a file name; null where there is none."""
    slots = F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv])
    return F.try_element_at(slots, extension_hash(extension(path)))


def sniffed(content: Column) -> Column:
    """The codec that the content's first bytes name; null where they name none."""
    head = F.hex(F.substring(content, 1, 8))
    cases = [
        ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("716F6966", "qoi"), ("424D", "bmp"), ("5031", "pbm"), ("5034", "pbm"), ("5032", "pgm"), ("5035", "pgm"),
        ("5033", "ppm"), ("5036", "ppm"), ("5046", "pfm"), ("5066", "pfm"), ("5037", "pam"),
    ]
    out = F.lit(None).cast("string")
    for magic, name in reversed(cases):
        out = F.when(head.startswith(magic), F.lit(name)).otherwise(out)
    return out
