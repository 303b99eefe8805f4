"""Big-endian fields of binary columns, as built-in expressions. Offsets count bytes from 0 and may be columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def piece(data: Column, at, size) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    size = size if isinstance(size, Column) else F.lit(size)
    return F.substring(data, at + 1, size)


def uint(data: Column, at, size: int) -> Column:
    """An unsigned number of up to 7 bytes; null beyond the end."""
    part = piece(data, at, size)
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))


def u8(data: Column, at) -> Column:
    return uint(data, at, 1)


def u16(data: Column, at) -> Column:
    return uint(data, at, 2)


def u24(data: Column, at) -> Column:
    return uint(data, at, 3)


def u32(data: Column, at) -> Column:
    return uint(data, at, 4)


def field(value: Column, shift: int, width: int) -> Column:
    """Bits of a number."""
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def after(data: Column, at) -> Column:
    """All bytes from at on."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.substring(data, at + 1, F.greatest(F.octet_length(data) - at, F.lit(0)))


def pts(data: Column, at) -> Column:
    """The 33-bit time of a PES header, in 90 kHz ticks."""
    a, b, c = u8(data, at), u16(data, at + 1), u16(data, at + 3)
    return F.shiftleft(field(a, 1, 3), 30) + F.shiftleft(field(b, 1, 15), 15) + field(c, 1, 15)
