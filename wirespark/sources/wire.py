"""Bits and values of one document: readers and writers of bits, the value table, typed values, options."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import decimal
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from wirespark.functions.times import KINDS
from wirespark.functions.values import BOOLEAN_FACET, CHARSETS
from wirespark.operators.dictionary import BoundedTable

COOKIE = b"$EXI"
XML_NS, XSI_NS = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2001/XMLSchema-instance"
XSD_NS, EXI_NS = "http://www.w3.org/2001/XMLSchema", "http://www.w3.org/2009/exi"
Name = tuple[str, str]  # namespace, local name
#: SE, AT, CH, EE, NS, CM, PI, DT, ER, SC with name (of a PI its target, of an NS namespace and prefix) and value
Event = tuple[str, Name | None, str | None]
#: The names that URI tables start with.
GIVEN = {"": [], XML_NS: ["base", "id", "lang", "space"], XSI_NS: ["nil", "type"]}
SPECIAL_EXPONENT = -16384


class Invalid(ValueError):
    """Bytes or values that the grammar doesn't allow."""


def width(n: int) -> int:
    return max(0, (n - 1).bit_length()) if n > 1 else 0


class BitWriter:
    """Most significant bit first; byte-aligned: n-bit fields take whole bytes, the least significant first."""

    def __init__(self, byte_aligned: bool = False):
        self._bytes, self._bits, self._n, self.byte_aligned = bytearray(), 0, 0, byte_aligned

    def put(self, value: int, size: int) -> None:
        self._bits, self._n = self._bits << size | value, self._n + size
        if self._n > 1024:
            rest = self._n % 8
            self._bytes += (self._bits >> rest).to_bytes(self._n // 8, "big")
            self._bits, self._n = self._bits & ((1 << rest) - 1), rest

    def nbit(self, value: int, size: int) -> None:
        if not size:
            return
        if value < 0 or value >> size:
            raise Invalid(f"{value} doesn't fit in {size} bits")
        if self.byte_aligned:
            size = (size + 7) // 8 * 8
            value = int.from_bytes(value.to_bytes(size // 8, "little"), "big")
        self.put(value, size)

    def align(self) -> None:
        self.put(0, -self._n % 8)

    def unsigned(self, value: int) -> None:
        if value < 0:
            raise Invalid(f"{value} is negative")
        while value >> 7:
            self.put(value & 127 | 128, 8)
            value >>= 7
        self.put(value, 8)

    def integer(self, value: int) -> None:
        self.nbit(int(value < 0), 1)
        self.unsigned(-value - 1 if value < 0 else value)

    def chars(self, text: str) -> None:
        for c in text:
            self.unsigned(ord(c))

    def string(self, text: str, more: int = 0) -> None:
        self.unsigned(len(text) + more)
        self.chars(text)

    def done(self) -> bytes:
        self.align()
        return bytes(self._bytes) + self._bits.to_bytes(self._n // 8, "big")


class BitReader:
    def __init__(self, data: bytes, at: int = 0, byte_aligned: bool = False):
        self.data, self.at, self.byte_aligned = data, at, byte_aligned

    def _take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise Invalid("the document ends too early")
        got = int.from_bytes(self.data[self.at // 8 : (end + 7) // 8], "big") >> (-end % 8) & ((1 << n) - 1)
        self.at = end
        return got

    def bits(self, n: int) -> int:
        """n bits; none or fewer are an error."""
        if n <= 0:
            raise Invalid(f"{n} bits")
        return self._take(n)

    def look_ahead(self) -> int | None:
        """The byte at the next boundary, without moving on; None at the end."""
        at = (self.at + 7) // 8
        return self.data[at] if at < len(self.data) else None

    def octets(self, n: int) -> bytes:
        """n bytes, from any bit."""
        return self._take(8 * n).to_bytes(n, "big") if n else b""

    def nbit(self, size: int) -> int:
        if not size:
            return 0
        if not self.byte_aligned:
            return self._take(size)
        n = (size + 7) // 8
        return int.from_bytes(self._take(8 * n).to_bytes(n, "big"), "little")

    def align(self) -> None:
        self.at += -self.at % 8

    def skip(self, n: int) -> None:
        """n bytes, from any bit."""
        self.at += 8 * n

    def unsigned(self) -> int:
        value = shift = 0
        while True:
            b = self._take(8)
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    def integer(self) -> int:
        negative = self.nbit(1)
        value = self.unsigned()
        return -value - 1 if negative else value

    def chars(self, n: int) -> str:
        return "".join(chr(self.unsigned()) for _ in range(n))

    def string(self, more: int = 0) -> str:
        return self.chars(self.unsigned() - more)


class Strings:
    """The value table of one document, both ways."""

    def __init__(self, capacity: int = -1, max_length: int = -1, local: bool = True, shared: tuple[str, ...] = ()):
        self.table = BoundedTable(capacity, max_length, local)
        for s in shared:
            self.table.add("", s)

    def write(self, out: BitWriter, ctx: str, value: str, charset: str | None = None) -> None:
        hit, number, size = self.table.find(ctx, value)
        if hit == "miss":
            if charset:
                out.unsigned(len(value) + 2)
                _write_characters(out, value, charset)
            else:
                out.string(value, 2)
            self.table.add(ctx, value)
        else:
            out.unsigned(0 if hit == "local" else 1)
            out.nbit(number, width(size))

    def read(self, source: BitReader, ctx: str, charset: str | None = None) -> str:
        n = source.unsigned()
        if n == 0:
            part = self.table.parts.get(ctx, [])
            value = part[source.nbit(width(len(part)))]
            if value is None:
                raise Invalid("a string that was dropped from the table")
            return value
        if n == 1:
            return self.table.values[source.nbit(width(len(self.table.values)))][0]
        value = _read_characters(source, n - 2, charset) if charset else source.chars(n - 2)
        self.table.add(ctx, value)
        return value


    def write_extended(self, out: BitWriter, ctx: str, value: str, members: list[str]) -> None:
        """Hits as ever, 2 and a place among members, else the length + 6 (3 to 5 are reserved)."""
        hit, _, _ = self.table.find(ctx, value)
        if hit != "miss":
            self.write(out, ctx, value)
        elif value in members:
            out.unsigned(2)
            out.nbit(members.index(value), width(len(members)))
        else:
            out.string(value, 6)
            self.table.add(ctx, value)

    def read_extended(self, source: BitReader, ctx: str, members: list[str]) -> str:
        before = source.at
        n = source.unsigned()
        if n < 2:
            source.at = before
            return self.read(source, ctx)
        if n == 2:
            i = source.nbit(width(len(members)))
            if i >= len(members):
                raise Invalid(f"no member {i}")
            return members[i]
        if n < 6:
            raise Invalid(f"a reserved kind of string, {n}")
        value = source.chars(n - 6)
        self.table.add(ctx, value)
        return value


def _float_parts(x: float) -> tuple[int, int]:
    if x != x:
        return 0, SPECIAL_EXPONENT
    if x in (float("inf"), float("-inf")):
        return (1 if x > 0 else -1), SPECIAL_EXPONENT
    sign, digits, exponent = decimal.Decimal(repr(x)).as_tuple()
    m = int("".join(map(str, digits)))
    while m and m % 10 == 0:
        m, exponent = m // 10, exponent + 1
    return (-m if sign else m), exponent if m else 0


def _reversed(digits: str) -> int:
    return int(digits[::-1] or "0")


def _write_characters(out: BitWriter, text: str, charset: str) -> None:
    """Characters by their places in a restricted set, others behind its escape code."""
    for c in text:
        at = charset.find(c)
        out.nbit(at if at >= 0 else len(charset), len(charset).bit_length())
        if at < 0:
            out.unsigned(ord(c))


def _read_characters(source: BitReader, n: int, charset: str) -> str:
    out = []
    for _ in range(n):
        at = source.nbit(len(charset).bit_length())
        if at > len(charset):
            raise Invalid(f"no character {at}")
        out.append(charset[at] if at < len(charset) else chr(source.unsigned()))
    return "".join(out)


def time_parts(text: str, kind: str) -> dict[str, Any]:
    """Parts of a date's or time's text (see functions/times.py), hour 24 resolved."""
    pattern, has = KINDS[kind]
    found = re.match(pattern, text.strip(" \t\r\n"), re.ASCII)
    if not found:
        raise Invalid(f"{text!r} is no {kind}")
    got = dict(zip([*has, "z"], found.groups(), strict=True))
    p: dict[str, Any] = {k: int(got[k]) if got.get(k) else 0 for k in "ymdhis"}
    p["f"] = (got.get("f") or "").rstrip("0")
    zone = got["z"]
    p["z"] = None if not zone else 0 if zone == "Z" else (int(zone[1:3]) * 64 + int(zone[4:])) * (-1 if zone[0] == "-" else 1)
    if p["h"] == 24:
        p["h"] = 0
        if "d" in has:
            day = dt.date(2000, p["m"], p["d"]) if not 0 < p["y"] < 9999 else dt.date(p["y"], p["m"], p["d"])
            after = day + dt.timedelta(days=1)
            p["y"], p["m"], p["d"] = p["y"] + after.year - day.year, after.month, after.day
    return p


def time_text(p: dict[str, Any], kind: str) -> str:
    year = f"{'-' if p['y'] < 0 else ''}{abs(p['y']):04d}"
    clock = f"{p['h']:02d}:{p['i']:02d}:{p['s']:02d}" + (f".{p['f']}" if p["f"] else "")
    text = {"gYear": year, "gYearMonth": f"{year}-{p['m']:02d}", "date": f"{year}-{p['m']:02d}-{p['d']:02d}", "dateTime": f"{year}-{p['m']:02d}-{p['d']:02d}T{clock}", "gMonth": f"--{p['m']:02d}", "gMonthDay": f"--{p['m']:02d}-{p['d']:02d}", "gDay": f"---{p['d']:02d}", "time": clock}[kind]
    z = p["z"]
    return text + ("" if z is None else "Z" if z == 0 else f"{'-' if z < 0 else '+'}{abs(z) // 64:02d}:{abs(z) % 64:02d}")


def write_time(out: BitWriter, p: dict[str, Any], kind: str) -> None:
    has = KINDS[kind][1]
    if "y" in has:
        out.integer(p["y"] - 2000)
    if "m" in has or "d" in has:
        out.nbit(p["m"] * 32 + p["d"], 9)
    if "h" in has:
        out.nbit((p["h"] * 64 + p["i"]) * 64 + p["s"], 17)
        out.nbit(int(bool(p["f"])), 1)
        if p["f"]:
            out.unsigned(_reversed(p["f"]))
    out.nbit(int(p["z"] is not None), 1)
    if p["z"] is not None:
        out.nbit(p["z"] + 896, 11)


def read_time(source: BitReader, kind: str) -> dict[str, Any]:
    has, p = KINDS[kind][1], dict.fromkeys("ymdhis", 0)
    if "y" in has:
        p["y"] = source.integer() + 2000
    if "m" in has or "d" in has:
        p["m"], p["d"] = divmod(source.nbit(9), 32)
    p["f"] = ""
    if "h" in has:
        t = source.nbit(17)
        p["h"], p["i"], p["s"] = t >> 12, t >> 6 & 63, t & 63
        p["f"] = str(source.unsigned())[::-1] if source.nbit(1) else ""
    p["z"] = source.nbit(11) - 896 if source.nbit(1) else None
    return p


def time_in_utc(p: dict[str, Any], kind: str) -> dict[str, Any]:
    """Parts moved to UTC; without a zone, as they are."""
    if not p["z"]:
        return p
    has = KINDS[kind][1]
    minutes = (abs(p["z"]) // 64 * 60 + abs(p["z"]) % 64) * (1 if p["z"] > 0 else -1)
    century = (p["y"] - 2000) // 400 * 400 if "y" in has else 0  # the calendar repeats: Python's years are few
    start = dt.datetime(p["y"] - century if "y" in has else 2000, p["m"] or 1, p["d"] or 1, p["h"], p["i"]) - dt.timedelta(minutes=minutes)
    moved = {"y": start.year + century, "m": start.month, "d": start.day, "h": start.hour, "i": start.minute}
    return p | {k: v for k, v in moved.items() if k in has} | {"z": 0}


def _zoned(text: str) -> bool:
    return bool(re.search(r"(Z|[+-][0-9]{2}:[0-9]{2})$", text))


def text_of(kind: T.DataType, value: Any) -> str:
    """A value's lexical form."""
    if isinstance(kind, T.BooleanType):
        return str(value).lower()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        m, e = _float_parts(value)
        return {1: "INF", -1: "-INF", 0: "NaN"}[m] if e == SPECIAL_EXPONENT else f"{m}E{e}"
    if isinstance(kind, T.BinaryType):
        return bytes(value).hex().upper()
    if isinstance(kind, T.DecimalType):
        return format(decimal.Decimal(value), "f")
    if isinstance(kind, T.TimestampType):
        return value.astimezone(dt.timezone.utc).isoformat().replace("+00:00", "Z") if value.tzinfo else f"{value.isoformat()}Z"
    return value.isoformat() if isinstance(kind, (T.DateType, T.TimestampNTZType)) else str(value)


def value_of(kind: T.DataType, text: str) -> Any:
    """The value of a lexical form; what isn't one is refused."""
    text = text.strip(" \t\r\n")
    try:
        if isinstance(kind, T.BooleanType):
            return {"true": True, "1": True, "false": False, "0": False}[text]
        if isinstance(kind, T.IntegralType):
            return int(text)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(text.replace("INF", "inf"))
        if isinstance(kind, T.BinaryType):
            return bytes.fromhex(text)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(text)
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(text)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = dt.datetime.fromisoformat(text)
            if isinstance(kind, T.TimestampNTZType):
                return value
            return value.astimezone(dt.timezone.utc) if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        if isinstance(kind, T.StringType):
            return text
    except (KeyError, ValueError, decimal.InvalidOperation) as e:
        raise Invalid(f"{text!r} is no {kind.simpleString()}") from e
    raise Invalid(f"no lexical form for {kind.simpleString()}")


def checked(kind: T.DataType, meta: dict, value: Any) -> Any:
    """A value that write_value() takes, from a value or its text; refuses what doesn't conform to the type."""
    if meta.get("list") and isinstance(kind, T.ArrayType):
        items = value.split() if isinstance(value, str) else value
        return [checked(kind.elementType, {k: v for k, v in meta.items() if k != "list"}, x) for x in items]
    if "xsd" in meta:
        time_parts(value, meta["xsd"])
        return value
    if meta.get("pattern"):
        if isinstance(value, str) and value.strip(" \t\r\n") not in BOOLEAN_FACET:
            raise Invalid(f"{value!r} is no boolean")
        return value.strip(" \t\r\n") if isinstance(value, str) else value
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        value = base64_value(value) if meta.get("base64") else value_of(kind, value)
    if "enum" in meta and value not in meta["enum"]:
        raise Invalid(f"{value!r} is no member")
    if "min" in meta and not meta["min"] <= value <= meta["max"] or meta.get("unsigned") and value < 0:
        raise Invalid(f"{value} is out of bounds")
    return value


def base64_value(text: str) -> bytes:
    try:
        return base64.b64decode("".join(text.split()), validate=True)
    except (binascii.Error, ValueError) as e:
        raise Invalid(f"{text!r} is no base64") from e


def custom_charset(members: str) -> str:
    """A set of one's own in the order of its codes: by code point; the given sets are as they are."""
    return members if members in CHARSETS.values() else "".join(sorted(set(members)))


def _charset(kind: T.DataType) -> str | None:
    """The restricted set of a type's lexical form."""
    for kinds, name in (((T.BooleanType,), "boolean"), ((T.IntegralType,), "integer"), ((T.DoubleType, T.FloatType), "double"), ((T.DecimalType,), "decimal"), ((T.BinaryType,), "hex"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "datetime")):
        if isinstance(kind, kinds):
            return CHARSETS[name]
    return None


#: What a datatype representation map may name, by the representation's name; register() adds to it.
REPRESENTATIONS: dict[str, tuple[T.DataType, dict]] = {
    "string": (T.StringType(), {}), "boolean": (T.BooleanType(), {}), "decimal": (T.DecimalType(38, 18), {"plain": True}), "double": (T.DoubleType(), {}), "integer": (T.LongType(), {}), "hexBinary": (T.BinaryType(), {}),
    **{k: (T.StringType(), {"xsd": k}) for k in KINDS},
}


def write_value(out: BitWriter, strings: Strings, ctx: str, kind: T.DataType, value: Any, meta: dict) -> None:
    """A typed value by its wire form; meta: enum, min and max, unsigned, charset, lexical (typed values as text), list (of a simple type), xsd (text of one of the kinds of dates and times), pattern (a boolean's spelling), extended (a string's likely values), utc."""
    if meta.get("list") and isinstance(kind, T.ArrayType):
        out.unsigned(len(value))
        for item in value:
            write_value(out, strings, ctx, kind.elementType, item, {k: v for k, v in meta.items() if k != "list"})
    elif "represent" in meta:
        other, more = REPRESENTATIONS[meta["represent"]]
        write_value(out, strings, ctx, other, checked(other, more, text_of(kind, value)), more)
    elif meta.get("lexical") and _charset(kind):
        strings.write(out, ctx, text_of(kind, value), _charset(kind))
    elif "charset" in meta:
        strings.write(out, ctx, value, custom_charset(meta["charset"]))
    elif "extended" in meta:
        strings.write_extended(out, ctx, value, meta["extended"])
    elif "xsd" in meta:
        p = time_parts(value, meta["xsd"])
        write_time(out, time_in_utc(p, meta["xsd"]) if meta.get("utc") else p, meta["xsd"])
    elif meta.get("pattern"):
        out.nbit(BOOLEAN_FACET.index(value if isinstance(value, str) else str(value).lower()), 2)
    elif meta.get("unsigned"):
        out.unsigned(value)
    elif "enum" in meta:
        if value not in meta["enum"]:
            raise Invalid(f"{value!r} is no member")
        out.nbit(meta["enum"].index(value), width(len(meta["enum"])))
    elif isinstance(kind, T.IntegralType) and "min" in meta:
        if not meta["min"] <= value <= meta["max"]:
            raise Invalid(f"{value} is out of bounds")
        out.nbit(value - meta["min"], width(meta["max"] - meta["min"] + 1))
    elif isinstance(kind, T.BooleanType):
        out.nbit(int(value), 1)
    elif isinstance(kind, T.IntegralType):
        out.integer(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        m, e = _float_parts(value)
        out.integer(m)
        out.integer(e)
    elif isinstance(kind, T.DecimalType):
        text = format(decimal.Decimal(value), "f")
        whole, _, part = text.lstrip("-").partition(".")
        out.nbit(int(text.startswith("-") and bool(decimal.Decimal(value))), 1)
        out.unsigned(int(whole or "0"))
        out.unsigned(_reversed(part))
    elif isinstance(kind, T.BinaryType):
        out.unsigned(len(value))
        for b in bytes(value):
            out.nbit(b, 8)
    elif isinstance(kind, T.DateType):
        out.integer(value.year - 2000)
        out.nbit(value.month * 32 + value.day, 9)
        out.nbit(0, 1)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out.integer(value.year - 2000)
        out.nbit(value.month * 32 + value.day, 9)
        out.nbit((value.hour * 64 + value.minute) * 64 + value.second, 17)
        out.nbit(int(value.microsecond > 0), 1)
        if value.microsecond:
            out.unsigned(_reversed(f"{value.microsecond:06d}".rstrip("0")))
        zoned = isinstance(kind, T.TimestampType)
        out.nbit(int(zoned), 1)
        if zoned:
            out.nbit(896, 11)
    elif isinstance(kind, T.StringType):
        strings.write(out, ctx, value)
    else:
        raise Invalid(f"no wire form for {kind.simpleString()}")


def read_value(source: BitReader, strings: Strings, ctx: str, kind: T.DataType, meta: dict) -> Any:
    if meta.get("list") and isinstance(kind, T.ArrayType):
        return [read_value(source, strings, ctx, kind.elementType, {k: v for k, v in meta.items() if k != "list"}) for _ in range(source.unsigned())]
    if "represent" in meta:
        other, more = REPRESENTATIONS[meta["represent"]]
        value = read_value(source, strings, ctx, other, more)
        text = value if isinstance(value, str) else text_of(other, value)
        return value_of(kind, text.removesuffix(".0") if isinstance(kind, T.IntegralType) else text)
    if meta.get("lexical") and _charset(kind):
        return value_of(kind, strings.read(source, ctx, _charset(kind)))
    if "charset" in meta:
        return strings.read(source, ctx, custom_charset(meta["charset"]))
    if "extended" in meta:
        return strings.read_extended(source, ctx, meta["extended"])
    if "xsd" in meta:
        return time_text(read_time(source, meta["xsd"]), meta["xsd"])
    if meta.get("pattern"):
        spelling = BOOLEAN_FACET[source.nbit(2)]
        return spelling if isinstance(kind, T.StringType) else spelling in ("true", "1")
    if meta.get("unsigned"):
        return source.unsigned()
    if "enum" in meta:
        i = source.nbit(width(len(meta["enum"])))
        if i >= len(meta["enum"]):
            raise Invalid(f"no member {i}")
        return meta["enum"][i]
    if isinstance(kind, T.IntegralType):
        return meta["min"] + source.nbit(width(meta["max"] - meta["min"] + 1)) if "min" in meta else source.integer()
    if isinstance(kind, T.BooleanType):
        return bool(source.nbit(1))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        m, e = source.integer(), source.integer()
        if e == SPECIAL_EXPONENT:
            return {1: float("inf"), -1: float("-inf")}.get(m, float("nan"))
        return float(f"{m}e{e}")
    if isinstance(kind, T.DecimalType):
        negative, whole, part = source.nbit(1), source.unsigned(), str(source.unsigned())[::-1]
        value = decimal.Decimal(f"{'-' if negative else ''}{whole}.{part}")
        return value if meta.get("plain") else value.quantize(decimal.Decimal(1).scaleb(-kind.scale), context=decimal.Context(prec=60))
    if isinstance(kind, T.BinaryType):
        return bytes(source.nbit(8) for _ in range(source.unsigned()))
    if isinstance(kind, T.DateType):
        year, md = source.integer() + 2000, source.nbit(9)
        if source.nbit(1):
            source.nbit(11)
        return dt.date(year, md >> 5, md & 31)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        year, md, t = source.integer() + 2000, source.nbit(9), source.nbit(17)
        micro = int(str(source.unsigned())[::-1].ljust(6, "0")[:6]) if source.nbit(1) else 0
        zone = source.nbit(11) - 896 if source.nbit(1) else 0
        made = dt.datetime(year, md >> 5, md & 31, t >> 12, t >> 6 & 63, t & 63, micro)
        made -= dt.timedelta(minutes=(abs(zone) // 64 * 60 + abs(zone) % 64) * (1 if zone >= 0 else -1))
        return made.replace(tzinfo=dt.timezone.utc) if isinstance(kind, T.TimestampType) else made
    if isinstance(kind, T.StringType):
        return strings.read(source, ctx)
    raise Invalid(f"no wire form for {kind.simpleString()}")


@dataclass
class Options:
    """What reader and writer agree on; everything else is in the header."""

    strict: bool = False
    fragment: bool = False
    byte_aligned: bool = False
    comments: bool = False
    pis: bool = False
    dtd: bool = False
    self_contained: bool = False
    max_productions: int = -1
    max_length: int = -1
    capacity: int = -1
    local: bool = True
    cookie: bool = False
    with_options: bool = False
    shared: tuple[str, ...] = field(default=())
    prefixes: bool = False
    lexical: bool = False
    max_grammars: int = -1
    keep_nil: bool = False
    utc: bool = False
    schema_id: str | None = None
    body_only: bool = False
    canonical: bool = False
    #: pairs of names in {namespace}local form: a type and its representation
    representations: tuple[tuple[str, str], ...] = field(default=())

    def strings(self) -> Strings:
        return Strings(self.capacity, self.max_length, self.local, self.shared)

    @classmethod
    def all_kept(cls) -> Options:
        """Everything that a document can keep, but for self-contained elements."""
        return cls(**dict.fromkeys(("comments", "pis", "dtd", "prefixes", "lexical"), True))

    def keeping(self, what: str, on: bool = True) -> Options:
        """These options with one thing kept or not. strict keeps nothing but lexical values; keeping anything else ends strict."""
        if what not in KEPT:
            raise Invalid(f"unknown option {what}")
        change: dict[str, bool] = {what: on}
        if on and what == "strict":
            change |= dict.fromkeys(KEPT - {"strict", "lexical"}, False)
        elif on and what != "lexical":
            change["strict"] = False
        return replace(self, **change)


#: What keeping() knows.
KEPT = frozenset({"strict", "comments", "pis", "dtd", "prefixes", "lexical", "self_contained"})
