"""Integers of any width, decimals and floats as values: parse, canonical form, arithmetic, comparison. Invalid text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirespark.functions.bits import bind, integer, unsigned

BLANK = " \t\r\n"
SPECIAL = -16384
#: Least and greatest values of the widths; beyond 64 bits integers are decimals of 38 digits.
INT, LONG = (-(1 << 31), (1 << 31) - 1), (-(1 << 63), (1 << 63) - 1)


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def integer_value(x: Column) -> Column:
    """(width, value) of an integer's text: 32, 64 or big by its number of characters (under 10 digits, under 19, more; a minus sign counts as one more on either side), and its value to 38 digits; a plus sign is dropped."""

    def made(t: Column) -> Column:
        n = F.length(t) - t.startswith("-").cast("int")
        width = F.when(n < 10, "32").when(n < 19, "64").otherwise("big")
        return F.when(t.rlike("^-?[0-9]+$"), F.struct(width.alias("width"), t.try_cast("decimal(38,0)").alias("value"), F.regexp_replace(t, "^(-?)0+(?=[0-9])", "$1").alias("text")))

    return bind(F.regexp_replace(F.btrim(x, F.lit(BLANK)), r"^\+", ""), made)


def narrowest(n: Column) -> Column:
    """The least width that holds a value."""
    return F.when(n.between(_big(INT[0]), _big(INT[1])), "32").when(n.between(_big(LONG[0]), _big(LONG[1])), "64").when(n.isNotNull(), "big")


def add(a: Column, b: Column) -> Column:
    """Sum of two integer values of any width, up to 38 digits; null beyond."""
    return F.try_add(a.cast("decimal(38,0)"), b.cast("decimal(38,0)")).cast("decimal(38,0)")


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a.cast("decimal(38,0)"), b.cast("decimal(38,0)")).cast("decimal(38,0)")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, across widths."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def sign(a: Column) -> Column:
    return compare(a, F.lit(0))


def digits(n: Column) -> Column:
    """An integer's text."""
    return n.cast("decimal(38,0)").cast("string")


def reversed_digits(n: Column) -> Column:
    """The text of an integer that isn't negative, last digit first."""
    return F.when(n >= 0, F.reverse(digits(n)))


def text_length(n: Column) -> Column:
    return F.length(digits(n))


def decimal_parts(x: Column) -> Column:
    """(negative, whole, fraction digits reversed) of a decimal's text; forms 1, .5 and 1.5; up to 18 digits on either side. There is no minus zero."""

    def made(t: Column) -> Column:
        bare = F.regexp_replace(t, "^[+-]", "")
        big = lambda y: F.coalesce(F.nullif(y, F.lit("")), F.lit("0")).cast("long")
        ok = t.rlike("^[+-]?([0-9]{1,18}|[0-9]{0,18}[.][0-9]{1,18})$")
        return F.when(ok, bind(F.split(bare, "[.]"), lambda s: bind(F.struct(big(s[0]).alias("w"), big(F.reverse(F.coalesce(F.try_element_at(s, F.lit(2)), F.lit("")))).alias("f")), lambda p: F.struct((t.startswith("-") & ((p["w"] != 0) | (p["f"] != 0))).alias("negative"), p["w"].alias("whole"), p["f"].alias("fraction")))))

    return bind(F.btrim(x, F.lit(BLANK)), made)


def decimal(x: Column) -> Column:
    """Bits of a decimal's text."""
    return bind(decimal_parts(x), decimal_bits)


def decimal_bits(p: Column) -> Column:
    return F.concat(F.when(p["negative"], "1").otherwise("0"), unsigned(p["whole"]), unsigned(p["fraction"]))


def decimal_text(x: Column) -> Column:
    """Canonical text: always a point, no needless zeros, no minus zero."""

    def made(t: Column, p: Column) -> Column:
        part = F.rtrim(F.split_part(t, F.lit("."), F.lit(2)), F.lit("0"))
        return F.when(p.isNotNull(), F.concat(F.when(p["negative"], "-").otherwise(""), p["whole"].cast("string"), F.lit("."), F.when(part == "", "0").otherwise(part)))

    return bind(F.btrim(x, F.lit(BLANK)), lambda t: bind(decimal_parts(t), lambda p: made(t, p)))


def float_parts(x: Column) -> Column:
    """(mantissa, exponent) in canonical form, no trailing zero in the mantissa; special values have exponent -16384."""
    made = lambda a, b: F.struct(a.cast("long").alias("mantissa"), b.cast("int").alias("exponent"))
    special = lambda n: made(F.lit(n), F.lit(SPECIAL))

    def number(t: Column, coefficient: Column, power: Column) -> Column:
        part = F.split_part(coefficient, F.lit("."), F.lit(2))
        found = F.ltrim(F.regexp_replace(coefficient, "[+.-]", ""), F.lit("0"))

        def canonical(all_digits: Column, bare: Column) -> Column:
            m = bare.try_cast("long") * F.when(t.startswith("-"), -1).otherwise(1)
            e = power - F.length(part) + F.length(all_digits) - F.length(bare)
            return F.when(bare == "", made(F.lit(0), F.lit(0))).when((F.length(bare) <= 18) & e.between(-16383, 16383), made(m, e))

        return bind(found, lambda d: bind(F.rtrim(d, F.lit("0")), lambda b: canonical(d, b)))

    def read(t: Column) -> Column:
        up = F.upper(t)
        power = F.coalesce(F.nullif(F.split_part(up, F.lit("E"), F.lit(2)), F.lit("")), F.lit("0")).cast("int")
        value = bind(F.split_part(up, F.lit("E"), F.lit(1)), lambda c: bind(power, lambda p: number(t, c, p)))
        return F.when(t == "INF", special(1)).when(t == "-INF", special(-1)).when(t == "NaN", special(0)).when(t.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,5})?$"), value)

    return bind(F.btrim(x, F.lit(BLANK)), read)


def float_bits(p: Column) -> Column:
    return bind(p, lambda p: F.concat(integer(p["mantissa"]), integer(p["exponent"])))


def float_text(p: Column) -> Column:
    special = lambda p: F.when(p["mantissa"] == 1, "INF").when(p["mantissa"] == -1, "-INF").otherwise("NaN")
    return bind(p, lambda p: F.when(p["exponent"] == SPECIAL, special(p)).otherwise(F.concat(p["mantissa"].cast("string"), F.lit("E"), p["exponent"].cast("string"))))


def float_double(p: Column) -> Column:
    """The double nearest to mantissa and exponent."""
    return bind(float_text(p), lambda t: F.when(t == "INF", F.lit(float("inf"))).when(t == "-INF", F.lit(float("-inf"))).when(t == "NaN", F.lit(float("nan"))).otherwise(t.try_cast("double")))


def float_from(x: Column) -> Column:
    """(mantissa, exponent) of a float or double, from its shortest text."""
    t = x.cast("string")
    return float_parts(F.when(t == "Infinity", "INF").when(t == "-Infinity", "-INF").otherwise(t))


def float_equal(p: Column, q: Column) -> Column:
    """Whether two (mantissa, exponent) are the same value: both are canonical, so if both parts are; NaN is itself."""
    return (p["mantissa"] == q["mantissa"]) & (p["exponent"] == q["exponent"])
