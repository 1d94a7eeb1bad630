"""Typed values: parse, canonical form, wire form. Invalid text gives null, which callers write as an untyped string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirespark.functions.bits import bind, nbit, unpack, unsigned, width
from wirespark.functions.numbers import integer_value

#: Spellings of the boolean with its pattern facet, by code.
BOOLEAN_FACET = ("false", "0", "true", "1")
BLANKS = "\t\n\r "
#: The restricted character sets, in order of their codes.
CHARSETS = {
    "base64": BLANKS + "+/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "boolean": BLANKS + "01aeflrstu",
    "datetime": BLANKS + "+-.0123456789:TZ",
    "decimal": BLANKS + "+-.0123456789",
    "double": BLANKS + "+-.0123456789EFINae",
    "hex": BLANKS + "0123456789ABCDEFabcdef",
    "integer": BLANKS + "+-0123456789",
    "string": "",
}


def replace_space(x: Column) -> Column:
    return F.translate(x, "\t\n\r", "   ")


def collapse_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(replace_space(x), " +", " "))


def only_space(x: Column) -> Column:
    return x.rlike(r"^[ \t\r\n]*\z")


def leading_space(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, "^[ \t\r\n]+", ""))


def trailing_space(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, r"[ \t\r\n]+\z", ""))


def chars(x: Column) -> Column:
    """The characters of a text."""
    return F.filter(F.split(x, ""), lambda c: F.length(c) > 0)


def characters(x: Column) -> Column:
    """Each character as an unsigned integer."""
    return F.array_join(F.transform(chars(x), lambda c: unsigned(F.ascii(c))), "")


def string(x: Column) -> Column:
    """A string without a table: its length in characters, then the characters."""
    return F.concat(unsigned(F.char_length(x)), characters(x))


def binary(x: Column) -> Column:
    """Length, then octets."""
    return F.concat(unsigned(F.octet_length(x)), unpack(x))


def boolean(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def boolean_facet(x: Column) -> Column:
    """The code of the spelling, null if it is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, BOOLEAN_FACET)), F.trim(x)), F.lit(0)) - 1


def boolean_bit(x: Column) -> Column:
    """The one bit of a boolean's text."""
    return F.when(boolean(x), "1").when(~boolean(x), "0")


def parsed_integer(x: Column) -> Column:
    return integer_value(x)["value"]


def base64_value(x: Column) -> Column:
    """The bytes of base64 text in its strict form, else null."""
    t = F.regexp_replace(x, "[ \t\r\n]", "")
    return F.when(t.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.unbase64(t))


def base64_length(x: Column) -> Column:
    """Characters of the base64 text of bytes."""
    return F.floor((F.octet_length(x) + 2) / 3) * 4


def bounded(x: Column, low: int, high: int) -> Column:
    """value - low in the bits of the range; null outside it."""
    return F.when(x.between(low, high), nbit(x - low, width(F.lit(high - low + 1))))


def enumeration(x: Column, members: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, members)), x)
    return F.when(at > 0, nbit(at - 1, (len(members) - 1).bit_length()))


def list_tokens(x: Column) -> Column:
    t = F.regexp_replace(x, "^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \t\r\n]+"))


def list_valid(x: Column, item: Callable[[Column], Column]) -> Column:
    """Whether every token is valid: item gives null for one that isn't."""
    return F.forall(list_tokens(x), lambda t: item(t).isNotNull())


def list_equal(x: Column, y: Column, item: Callable[[Column], Column]) -> Column:
    """Whether two lists hold equal items in the same order, as values."""
    return F.transform(list_tokens(x), item).eqNullSafe(F.transform(list_tokens(y), item))


def list_of(x: Column, item: Callable[[Column], Column]) -> Column:
    """Number of items, then each by its codec."""
    return bind(list_tokens(x), lambda tokens: F.concat(unsigned(F.size(tokens)), F.array_join(F.transform(tokens, item), "")))


def custom_charset(members: str) -> str:
    """A set of one's own in the order of its codes: by code point."""
    return "".join(sorted(set(members)))


def charset_characters(x: Column, charset: str) -> Column:
    """The characters of a text by their places in a restricted set, others behind its escape code."""
    size, bits = len(charset), len(charset).bit_length()
    codes = F.create_map(*[F.lit(v) for i, c in enumerate(charset) for v in (c, format(i, f"0{bits}b"))]) if charset else None
    escape = lambda c: F.concat(nbit(F.lit(size), bits), unsigned(F.ascii(c)))
    code = (lambda c: F.coalesce(F.try_element_at(codes, c), escape(c))) if charset else escape
    return F.array_join(F.transform(chars(x), code), "")


def charset_string(x: Column, charset: str) -> Column:
    """A string of a restricted set that the table lacks: length + 2, then its characters' codes."""
    return F.concat(unsigned(F.char_length(x) + 2), charset_characters(x, charset))
