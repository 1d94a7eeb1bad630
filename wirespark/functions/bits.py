"""Bit strings: n-bit fields, 7-bit groups, packing. A bit string is a string of 0 and 1, most significant bit first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits that conv() takes at a time.
BLOCK = 64


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def width(n: Column) -> Column:
    """Bits that tell n alternatives apart: 0 for one or none."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin((n - 1).cast("long"))))


def groups(n: Column) -> Column:
    """7-bit groups of a value that isn't negative."""
    return F.floor((F.length(F.bin(n.cast("long"))) + 6) / 7).cast("int")


def nbit(value: Column, size: Column | int) -> Column:
    """value in exactly size bits; no bits for size 0."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(size <= 0, F.lit("")).otherwise(F.lpad(F.bin(value.cast("long")), size.cast("int"), F.lit("0")))


def byte_aligned(value: Column, size: Column | int) -> Column:
    """An n-bit field on a byte channel: as many whole bytes as it needs, the least significant first."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.floor((size + 7) / 8).cast("int")
    byte = lambda i: nbit(F.call_function("shiftright", value.cast("long"), (i * 8).cast("int")).bitwiseAND(255), 8)
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), byte), ""))


def unsigned(n: Column) -> Column:
    """Groups of 7 bits in bytes, the least significant first; the top bit says that more follow."""

    def made(n: Column) -> Column:
        byte = lambda i: nbit(F.call_function("shiftright", n, (i * 7).cast("int")).bitwiseAND(127) + F.when(F.call_function("shiftrightunsigned", n, (i * 7).cast("int")) > 127, 128).otherwise(0), 8)
        return F.array_join(F.transform(F.sequence(F.lit(0), groups(n) - 1), byte), "")

    return bind(n.cast("long"), made)


def integer(n: Column) -> Column:
    """A sign bit, then n, or -n - 1 for negative n."""
    return bind(n.cast("long"), lambda n: F.concat(F.when(n < 0, "1").otherwise("0"), unsigned(F.when(n < 0, -n - 1).otherwise(n))))


def pack(bits: Column) -> Column:
    """Bytes of a bit string, filled up with zeros."""

    def made(even: Column) -> Column:
        block = lambda i: bind(F.substring(even, i, F.lit(BLOCK)), lambda b: F.lpad(F.conv(b, 2, 16), F.floor(F.length(b) / 4).cast("int"), F.lit("0")))
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.length(even), F.lit(BLOCK)), block), ""))

    even = bind(bits, lambda b: F.rpad(b, (F.floor((F.length(b) + 7) / 8) * 8).cast("int"), F.lit("0")))
    return F.when(F.length(bits) == 0, F.unhex(F.lit(""))).otherwise(bind(even, made))


def unpack(data: Column) -> Column:
    """The bit string of bytes."""

    def made(h: Column) -> Column:
        block = lambda i: bind(F.substring(h, i, F.lit(BLOCK // 4)), lambda b: F.lpad(F.conv(b, 16, 2), F.length(b) * 4, F.lit("0")))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(h), F.lit(BLOCK // 4)), block), "")

    return F.when(F.octet_length(data) == 0, F.lit("")).otherwise(bind(F.hex(data), made))


def read(bits: Column, at: Column, size: Column | int) -> Column:
    """The n-bit value at a 0-based place; null if that is no place or n isn't 1 to 63."""
    size = F.lit(size) if isinstance(size, int) else size
    ok = size.between(1, 63) & (at >= 0) & (at + size <= F.length(bits))
    return F.when(ok, F.conv(F.substring(bits, (at + 1).cast("int"), size.cast("int")), 2, 10).cast("long"))


def read_bytes(bits: Column, at: Column, n: Column | int) -> Column:
    """n octets from any bit; null if they aren't there."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when((n >= 0) & (at + n * 8 <= F.length(bits)), pack(F.substring(bits, (at + 1).cast("int"), (n * 8).cast("int"))))


def look_ahead(bits: Column, at: Column) -> Column:
    """The byte that comes next on a byte boundary, without moving on; null at the end."""
    return read(bits, aligned(at), 8)


def read_unsigned(bits: Column, at: Column) -> Column:
    """(value, next place) of an unsigned integer of up to 63 bits."""
    rest = F.substring(bits, (at + 1).cast("int"), F.lit(72))
    # bytes that say more follow, then one that doesn't
    size = F.length(F.regexp_extract(rest, "^(?:1[01]{7})*0[01]{7}", 0))

    def made(body: Column) -> Column:
        group = lambda i: F.substring(body, F.length(body) - i * 8 - 6, F.lit(7))
        digits = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(body) / 8).cast("int") - 1), group), "")
        return F.struct(F.conv(digits, 2, 10).cast("long").alias("value"), (at + F.length(body)).cast("long").alias("next"))

    return F.when(size > 0, bind(F.substring(rest, F.lit(1), size), made))


def read_integer(bits: Column, at: Column) -> Column:
    """(value, next place) of a signed integer."""
    negative = F.substring(bits, (at + 1).cast("int"), F.lit(1)) == "1"
    return bind(read_unsigned(bits, at + 1), lambda u: F.struct(F.when(negative, -u["value"] - 1).otherwise(u["value"]).alias("value"), u["next"].alias("next")))


def aligned(at: Column) -> Column:
    """The next byte boundary at or after a bit place."""
    return (F.floor((at + 7) / 8) * 8).cast("long")
