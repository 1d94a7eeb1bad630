"""Dates and times of the eight kinds: parts, wire form, canonical text, UTC, equality. Invalid text gives null.

A text is read once, by places from its ends, after one pattern has said that it is valid; what is used more than once is
bound by bits.bind(), since the optimizer would paste it everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirespark.functions.bits import bind, integer, nbit, unsigned

YEAR, MONTH, DAY, TIME = r"(-?[0-9]{4,})", r"(0[1-9]|1[0-2])", r"(0[1-9]|[12][0-9]|3[01])", r"([01][0-9]|2[0-4]):([0-5][0-9]):([0-5][0-9]|60)(?:[.]([0-9]{1,18}))?"
ZONE = r"(Z|[+-](?:0[0-9]|1[0-4]):[0-5][0-9])?$"
#: Pattern and parts of each kind; f: fraction of a second.
KINDS: dict[str, tuple[str, str]] = {
    "gYear": (f"^{YEAR}{ZONE}", "y"), "gYearMonth": (f"^{YEAR}-{MONTH}{ZONE}", "ym"), "date": (f"^{YEAR}-{MONTH}-{DAY}{ZONE}", "ymd"), "dateTime": (f"^{YEAR}-{MONTH}-{DAY}T{TIME}{ZONE}", "ymdhisf"),
    "gMonth": (f"^--{MONTH}(?:--)?{ZONE}", "m"), "gMonthDay": (f"^--{MONTH}-{DAY}{ZONE}", "md"), "gDay": (f"^---{DAY}{ZONE}", "d"), "time": (f"^{TIME}{ZONE}", "hisf"),
}
PARTS = ("year", "month", "day", "hour", "minute", "second", "fraction", "zone")


def _struct(*values: Column) -> Column:
    return F.struct(*[v.cast("string" if n == "fraction" else "long").alias(n) for n, v in zip(PARTS, values, strict=True)])


def parts(x: Column, kind: str) -> Column:
    """year, month, day, hour, minute, second (0 where the kind lacks them), fraction (digits without needless zeros; null: none) and zone (minutes; null: none); hour 24 is as it stands."""
    pattern, has = KINDS[kind]
    zero = F.lit(0)

    def read(t: Column, zone_size: Column, year_end: Column) -> Column:
        n = F.length(t) - zone_size
        two = lambda at: F.substring(t, at if isinstance(at, Column) else F.lit(at), F.lit(2)).cast("int")
        year = F.substring(t, F.lit(1), n if kind == "gYear" else year_end).cast("long") if "y" in has else zero
        month = two(year_end + 2) if "y" in has and "m" in has else two(3) if "m" in has else zero
        day = two(year_end + 5) if "y" in has and "d" in has else two({"gMonthDay": 6, "gDay": 4}[kind]) if "d" in has else zero
        clock = year_end + 8 if kind == "dateTime" else F.lit(1)
        hour, minute, second = (two(clock + k) if "h" in has else zero for k in (0, 3, 6))
        digits = F.nullif(F.rtrim(F.substring(t, clock + 9, n - clock - 8), F.lit("0")), F.lit("")) if "f" in has else F.lit(None)
        own = F.substring(t, n + 1, zone_size)
        minutes = (F.substring(own, 2, 2).cast("int") * 60 + F.substring(own, 5, 2).cast("int")) * F.when(own.startswith("-"), -1).otherwise(1)
        return _struct(year, month, day, hour, minute, second, digits, F.when(zone_size == 1, 0).when(zone_size == 6, minutes))

    def valid(t: Column) -> Column:
        sign = F.substring(t, -6, 1)
        zone_size = F.when(t.endswith("Z"), 1).when(sign.isin("+", "-") & (F.substring(t, -3, 1) == ":"), 6).otherwise(0)
        # the year ends before the first hyphen that isn't its sign
        year_end = F.instr(F.substring(t, F.lit(2), F.length(t)), "-") if "y" in has else F.lit(0)
        return bind(zone_size, lambda z: bind(year_end, lambda y: read(t, z, y)))

    return bind(F.btrim(x, F.lit(" \t\r\n")), lambda t: F.when(t.rlike(pattern), valid(t)))


def days_in_month(year: Column, month: Column) -> Column:
    """Days of a month; months outside 1 to 12 count on into other years."""
    m = F.pmod(month - 1, F.lit(12)) + 1
    y = year + F.floor((month - 1) / 12)
    leap = (F.pmod(y, F.lit(400)) == 0) | ((F.pmod(y, F.lit(100)) != 0) & (F.pmod(y, F.lit(4)) == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def quotient(a: Column, low: Column | int, high: Column | int) -> Column:
    """Floor of (a - low) / (high - low)."""
    return F.floor((a - low) / (high - low))


def modulo(a: Column, low: Column | int, high: Column | int) -> Column:
    return F.pmod(a - low, F.lit(high) - F.lit(low)) + low


def _moved(p: Column, kind: str, minutes: Column, zone: Column) -> Column:
    """parts moved on by minutes (less than two days) with carry into hours, days, months and years; seconds, leap ones too, stay. What the kind lacks counts as the year 2000, month 1, day 1, and stays away."""
    has = KINDS[kind][1]
    total = p["hour"] * 60 + p["minute"] + minutes
    year, month = p["year"] if "y" in has else F.lit(2000), p["month"] if "m" in has else F.lit(1)

    def carry(minute: Column, y: Column, m: Column, d: Column) -> Column:
        keep = lambda part, v: v if part in has else F.lit(0)
        return _struct(keep("y", y), keep("m", m), keep("d", d), keep("h", F.floor(minute / 60)), keep("i", F.pmod(minute, F.lit(60))), p["second"], p["fraction"], zone)

    def from_day(minute: Column, day: Column) -> Column:
        last = days_in_month(year, month)
        back, on = day < 1, day > last
        shifted = month - back.cast("int") + on.cast("int")
        new_day = F.when(back, day + days_in_month(year, month - 1)).when(on, day - last).otherwise(day)
        return carry(minute, year + quotient(shifted, 1, 13), modulo(shifted, 1, 13), new_day)

    start = F.greatest(F.lit(1), p["day"]) if "d" in has else F.lit(1)
    return bind(total, lambda n: bind(start + F.floor(n / 1440), lambda d: from_day(F.pmod(n, F.lit(1440)), d)))


def rolled(p: Column, kind: str) -> Column:
    """parts in which hour 24 is hour 0 of the next day."""
    return bind(p, lambda q: F.when(q["hour"] == 24, _moved(q, kind, F.lit(0), q["zone"])).otherwise(q)) if "h" in KINDS[kind][1] else p


def normalised(p: Column, kind: str) -> Column:
    """parts in UTC; without a zone only hour 24 is resolved."""
    return bind(p, lambda q: F.when(q["zone"].isNull() | (q["zone"] == 0), rolled(q, kind)).otherwise(_moved(q, kind, -q["zone"], F.lit(0))))


def wire_parts(p: Column) -> Column:
    """year, month_day, time, fraction (its digits reversed; null: none) and zone (hours * 64 + minutes; null: none) as the wire has them."""
    return bind(p, lambda q: F.when(q.isNotNull(), F.struct(
        q["year"].alias("year"), (q["month"] * 32 + q["day"]).alias("month_day"), ((q["hour"] * 64 + q["minute"]) * 64 + q["second"]).alias("time"), F.reverse(q["fraction"]).cast("long").alias("fraction"),
        (F.signum(q["zone"]).cast("int") * (F.floor(F.abs(q["zone"]) / 60) * 64 + F.pmod(F.abs(q["zone"]), F.lit(60)))).alias("zone"),
    )))


def wire(p: Column, kind: str) -> Column:
    """Bits of parts; hour 24 is resolved."""
    has = KINDS[kind][1]

    def made(w: Column) -> Column:
        out = [integer(w["year"] - 2000)] if "y" in has else []
        if "m" in has or "d" in has:
            out.append(nbit(w["month_day"], 9))
        if "h" in has:
            out += [nbit(w["time"], 17), F.when(w["fraction"].isNull(), "0").otherwise(F.concat(F.lit("1"), unsigned(w["fraction"])))]
        return F.concat(*out, F.when(w["zone"].isNull(), "0").otherwise(F.concat(F.lit("1"), nbit(w["zone"] + 896, 11))))

    return bind(wire_parts(rolled(p, kind)), made)


def datetime(x: Column, kind: str) -> Column:
    """Bits of a text."""
    return wire(parts(x, kind), kind)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def text(p: Column, kind: str) -> Column:
    """Canonical text of parts: four digits of the year at least, no needless zeros in fractions, Z for UTC."""
    has = KINDS[kind][1]

    def made(q: Column) -> Column:
        year = F.concat(F.when(q["year"] < 0, "-").otherwise(""), F.lpad(F.abs(q["year"]).cast("string"), F.greatest(F.lit(4), F.length(F.abs(q["year"]).cast("string"))), F.lit("0")))
        clock = F.concat(_two(q["hour"]), F.lit(":"), _two(q["minute"]), F.lit(":"), _two(q["second"]), F.when(q["fraction"].isNull(), "").otherwise(F.concat(F.lit("."), q["fraction"])))
        month, day, dash = _two(q["month"]), _two(q["day"]), F.lit("-")
        forms = {
            "gYear": (year,), "gYearMonth": (year, dash, month), "date": (year, dash, month, dash, day), "dateTime": (year, dash, month, dash, day, F.lit("T"), clock),
            "gMonth": (F.lit("--"), month), "gMonthDay": (F.lit("--"), month, dash, day), "gDay": (F.lit("---"), day), "time": (clock,),
        }
        away = F.abs(q["zone"])
        zone = F.when(q["zone"].isNull(), "").when(q["zone"] == 0, "Z").otherwise(F.concat(F.when(q["zone"] < 0, "-").otherwise("+"), _two(F.floor(away / 60)), F.lit(":"), _two(F.pmod(away, F.lit(60)))))
        return F.when(q.isNotNull(), F.concat(*forms[kind], zone))

    assert has
    return bind(p, made)


def to_utc(x: Column, kind: str = "dateTime") -> Column:
    """Canonical text in UTC."""
    return text(normalised(parts(x, kind), kind), kind)


def equal(x: Column, y: Column, kind: str) -> Column:
    """Whether two texts are the same time: by their parts, else by those in UTC. One with a zone and one without differ."""
    both: Callable[[Column], Column] = lambda t: bind(parts(t, kind), lambda p: F.when(p.isNotNull(), F.struct(p.alias("p"), normalised(p, kind).alias("n"))))
    return bind(both(x), lambda a: bind(both(y), lambda b: F.when(a.isNotNull() & b.isNotNull(), F.to_json(a["p"]).eqNullSafe(F.to_json(b["p"])) | F.to_json(a["n"]).eqNullSafe(F.to_json(b["n"])))))


def from_timestamp(ts: Column, kind: str = "dateTime") -> Column:
    """parts of a timestamp, in UTC if it has a zone."""
    has = KINDS[kind][1]
    micros = F.lpad((F.unix_micros(ts.cast("timestamp")) % 1_000_000).cast("string"), 6, "0")
    got = {"y": F.year(ts), "m": F.month(ts), "d": F.day(ts), "h": F.hour(ts), "i": F.minute(ts), "s": F.second(ts), "f": F.nullif(F.rtrim(micros, F.lit("0")), F.lit(""))}
    return F.when(ts.isNotNull(), _struct(*(got[p] if p in has else F.lit(None if p == "f" else 0) for p in "ymdhisf"), F.lit(0)))


def to_timestamp(p: Column) -> Column:
    """The UTC timestamp of a dateTime's parts; a leap second is the first of the next minute, the fraction is cut to microseconds."""
    def made(q: Column) -> Column:
        whole = F.make_timestamp(q["year"].cast("int"), q["month"].cast("int"), q["day"].cast("int"), q["hour"].cast("int"), q["minute"].cast("int"), F.lit(0), F.lit("UTC"))
        micros = q["second"] * 1_000_000 + F.rpad(F.coalesce(q["fraction"], F.lit("")), 6, "0").cast("long")
        return F.when(q.isNotNull(), F.timestamp_micros(F.unix_micros(whole) + micros))

    return bind(normalised(p, "dateTime"), made)
