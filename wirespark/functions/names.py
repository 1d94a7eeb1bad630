"""Qualified names, code points and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of namespaces with a prefix of their own.
DEFAULT_PREFIXES = {0: "", 1: "xml", 2: "xsi"}


def qname(x: Column) -> Column:
    """(prefix, local) split at the first colon."""
    has = F.instr(x, ":") > 0
    return F.struct(F.when(has, F.split_part(x, F.lit(":"), F.lit(1))).alias("prefix"), F.when(has, F.substring(x, F.instr(x, ":") + 1, F.length(x))).otherwise(x).alias("local"))


def qname_text(prefix: Column, local: Column) -> Column:
    """prefix:local, or local without a prefix."""
    return F.concat_ws(":", F.nullif(prefix, F.lit("")), local)


def qname_equal(ns: Column, local: Column, other_ns: Column, other_local: Column) -> Column:
    """Whether names are the same; prefixes have no say."""
    return ns.eqNullSafe(other_ns) & local.eqNullSafe(other_local)


def qname_order(ns: Column, local: Column) -> Column:
    """What names are sorted by: local name, then namespace."""
    return F.struct(local.alias("local"), ns.alias("ns"))


def default_prefix(namespace_id: Column) -> Column:
    """The prefix of a namespace by its number: none, xml, xsi, then ns3, ns4, ..."""
    known = F.create_map(*[F.lit(v) for kv in DEFAULT_PREFIXES.items() for v in kv])
    return F.coalesce(F.try_element_at(known, namespace_id.cast("int")), F.concat(F.lit("ns"), namespace_id.cast("string")))


def is_code_point(n: Column) -> Column:
    return n.between(0, 0x10FFFF)


def code_point_count(x: Column, start: Column | int = 0, stop: Column | None = None) -> Column:
    """Code points of a text's UTF-8 bytes from start up to stop; null where these aren't in the text or cut a character."""
    raw = F.encode(x, "UTF-8")
    start = F.lit(start) if isinstance(start, int) else start
    stop = F.octet_length(x) if stop is None else stop
    # the first byte of a character isn't of the form 10xxxxxx
    part = F.hex(F.substring(raw, start + 1, stop - start))
    lead = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1)), F.lit(2)), lambda i: F.substring(part, i, F.lit(1))), lambda c: (c != "") & ~c.isin("8", "9", "A", "B")))
    return F.when((start >= 0) & (stop <= F.octet_length(x)) & (start <= stop), lead.cast("long"))


def text_equal(x: Column, y: Column) -> Column:
    """Whether two strings are equal as values, null beside null too."""
    return x.eqNullSafe(y)
