"""Numbers in binary columns. Offsets count from 0."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def u8(b: Column, at: int | Column) -> Column:
    """The byte at a place, as an int; null beyond the end."""
    piece = F.substring(b, at + 1, 1) if isinstance(at, int) else F.substring(b, (at + 1).cast("int"), F.lit(1))
    return F.conv(F.hex(piece), 16, 10).cast("int")


def _be(b: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(b, at + 1, n)), 16, 10).cast("long")


def u16be(b: Column, at: int) -> Column:
    return _be(b, at, 2).cast("int")


def u32be(b: Column, at: int) -> Column:
    return _be(b, at, 4)


def _le(b: Column, at: int, n: int) -> Column:
    h = F.hex(F.substring(b, at + 1, n))
    return F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long")


def u16le(b: Column, at: int) -> Column:
    return _le(b, at, 2).cast("int")


def u32le(b: Column, at: int) -> Column:
    return _le(b, at, 4)


def i32le(b: Column, at: int) -> Column:
    v = u32le(b, at)
    return F.when(v >= 2**31, v - 2**32).otherwise(v).cast("int")


def _signed(v: Column, bits: int) -> Column:
    return F.when(v >= 2 ** (bits - 1), v - 2**bits).otherwise(v)


def i16be(b: Column, at: int) -> Column:
    return _signed(u16be(b, at), 16)


def i16le(b: Column, at: int) -> Column:
    return _signed(u16le(b, at), 16)


def i32be(b: Column, at: int) -> Column:
    return _signed(u32be(b, at), 32).cast("int")


def i64be(b: Column, at: int) -> Column:
    return F.shiftleft(u32be(b, at), 32).bitwiseOR(u32be(b, at + 4))


def i64le(b: Column, at: int) -> Column:
    return F.shiftleft(u32le(b, at + 4), 32).bitwiseOR(u32le(b, at))


def _unsigned64(v: Column) -> Column:
    wide = v.cast("decimal(20,0)")
    return F.when(v < 0, wide + F.lit(Decimal(2**64))).otherwise(wide).cast("decimal(20,0)")


def u64be(b: Column, at: int) -> Column:
    """As decimal(20,0): a long has no room for it."""
    return _unsigned64(i64be(b, at))


def u64le(b: Column, at: int) -> Column:
    return _unsigned64(i64le(b, at))


def _float(sign: Column, exponent: Column, fraction: Column, bits: int, bias: int) -> Column:
    """An IEEE number from its parts, exact: scaling by powers of two rounds nothing."""
    part = fraction.cast("double") / F.lit(float(2**bits))
    number = F.when(exponent == 0, part * F.lit(2.0 ** (1 - bias))).otherwise((part + 1) * F.pow(F.lit(2.0), (exponent - bias).cast("double")))
    number = F.when(exponent == 2 * bias + 1, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(number)
    return F.when(sign != 0, -number).otherwise(number)


def _f32(v: Column) -> Column:
    bits = lambda shift, mask: F.shiftright(v, shift).bitwiseAND(F.lit(mask).cast("long"))
    return _float(bits(31, 1), bits(23, 0xFF), bits(0, 0x7FFFFF), 23, 127).cast("float")


def _f64(high: Column, low: Column) -> Column:
    bits = lambda shift, mask: F.shiftright(high, shift).bitwiseAND(F.lit(mask).cast("long"))
    return _float(bits(31, 1), bits(20, 0x7FF), F.shiftleft(bits(0, 0xFFFFF), 32).bitwiseOR(low), 52, 1023)


def f32be(b: Column, at: int) -> Column:
    return _f32(u32be(b, at))


def f32le(b: Column, at: int) -> Column:
    return _f32(u32le(b, at))


def f64be(b: Column, at: int) -> Column:
    return _f64(u32be(b, at), u32be(b, at + 4))


def f64le(b: Column, at: int) -> Column:
    return _f64(u32le(b, at + 4), u32le(b, at))


def samples(data: Column) -> Column:
    """The bytes of a binary as an array of ints."""
    digits = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("int"))


def from_samples(v: Column) -> Column:
    """A binary of an array of ints 0..255."""
    return F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
