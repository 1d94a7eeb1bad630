"""Nested rows as events and back: names from metadata, unknown elements skipped, nil, named types, wildcards as XML text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from wirespark.sources.machine import NIL, TYPE, Machine, clark, from_clark, sane
from wirespark.sources.schema import Schema, is_attribute, item_type, many, xml_name
from wirespark.sources.wire import Event, Invalid, Options, base64_value, value_of


def tag(text: str) -> dict[str, Any]:
    """Metadata of a field from a tag `[namespace ]name[,attr|chardata]`."""
    names, *kinds = (x.strip() for x in text.split(","))
    ns, _, local = names.rpartition(" ")
    return {k: v for k, v in (("ns", ns.strip()), ("name", local), ("kind", next((k for k in kinds if k in ("attr", "chardata")), ""))) if v}


def tagged(name: str, kind: T.DataType, text: str, nullable: bool = True) -> T.StructField:
    """A field by its tag: an attribute's name gets its `_`, text beside attributes is `_VALUE`."""
    meta = tag(text)
    where = meta.pop("kind", "")
    if where == "chardata":
        return T.StructField("_VALUE", kind, nullable, {})
    if where == "attr":
        return T.StructField(f"_{name}", kind, nullable, {"name": name} | meta)
    return T.StructField(name, kind, nullable, {"name": name} | meta)


def plain_text(value: Any) -> str:
    """A value's text where its type has no say: integers, shortest floats without exponent, true and false, lists by spaces."""
    import datetime as dt
    import decimal

    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return "NaN" if value != value else "INF" if value > 0 else "-INF"
        return format(decimal.Decimal(repr(value)), "f").removesuffix(".0")
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex().upper()
    if isinstance(value, list):
        return " ".join(map(plain_text, value))
    return str(value)


def _get(row: Any, name: str) -> Any:
    return row.get(name) if isinstance(row, dict) else getattr(row, name, None) if not hasattr(row, "asDict") else row.asDict().get(name)


def to_events(f: T.StructField, row: Any, typed: bool = True) -> list[Event]:
    """Events of an element; typed False: all values as text, as documents without a schema have them. Null fields are absent, or nil if they may be; empty attributes are left out of documents without a schema."""
    out: list[Event] = []
    text = (lambda v: v) if typed else plain_text

    def element(f: T.StructField, value: Any) -> None:
        kind, name = item_type(f), xml_name(f)
        out.append(("SE", name, None))
        if value is None:
            if not f.metadata.get("nillable"):
                raise Invalid(f"an item of {f.name} is null, and the field isn't nillable")
            out.append(("AT", NIL, "true"))
        elif isinstance(kind, T.StructType):
            if (named := _get(value, "_xsi_type")) is not None:
                out.append(("AT", TYPE, clark((f.metadata.get("ns", ""), named))))
            attributes = sorted((g for g in kind if is_attribute(g)), key=lambda g: xml_name(g, True)[::-1])
            out.extend(("AT", xml_name(g, True), text(v)) for g in attributes if (v := _get(value, g.name)) is not None and (typed or v != ""))
            if (v := _get(value, "_VALUE")) is not None:
                out.append(("CH", None, text(v)))
            for g in kind:
                if not g.name.startswith("_"):
                    child(g, _get(value, g.name))
        else:
            out.append(("CH", None, text(value)))
        out.append(("EE", None, None))

    def child(g: T.StructField, value: Any) -> None:
        if value is None and not (g.metadata.get("nillable") and not g.nullable):
            return
        if g.metadata.get("any"):
            from wirespark.sources.exi import parse_xml

            for x in value if isinstance(value, list) else [value]:
                out.extend(parse_xml(x))
        elif many(g):
            for item in value:
                element(g, item)
        else:
            element(g, value)

    element(f, row)
    return out


def from_events(f: T.StructField, events: list[Event]) -> dict[str, Any]:
    """The row of an element's events. Names are found by tag, then exactly, then without regard to case; namespaces and what the schema lacks are passed over."""
    at = 0

    def lookup(kind: T.StructType, attributes: bool) -> dict[str, T.StructField]:
        fields = [g for g in kind if is_attribute(g) == attributes and g.name not in ("_VALUE", "_xsi_type")]
        found: dict[str, T.StructField] = {}
        for key in (lambda g: xml_name(g, attributes)[1], lambda g: g.name[attributes:], lambda g: g.name[attributes:].lower()):
            for g in fields:
                found.setdefault(key(g), g)
        return found

    def resolve(names: dict[str, T.StructField], local: str) -> T.StructField | None:
        return names.get(local) or names.get(local.lower())

    def skip() -> list[Event]:
        """Passes over an element that has begun; its events."""
        nonlocal at
        begin, depth = at - 1, 1
        while depth:
            depth += {"SE": 1, "EE": -1}.get(events[at][0], 0)
            at += 1
        return events[begin:at]

    def value(kind: T.DataType, meta: dict, text: str) -> Any:
        if isinstance(kind, T.ArrayType):
            return [value(kind.elementType, meta, x) for x in text.split()]
        if isinstance(kind, T.StringType):
            return text
        if not text.strip():
            return b"" if isinstance(kind, T.BinaryType) else None
        return base64_value(text) if meta.get("base64") else value_of(kind, text)

    def element(kind: T.DataType, meta: dict) -> Any:
        nonlocal at
        text, nil, rows = [], False, isinstance(kind, T.StructType)
        row: dict[str, Any] = {g.name: [] if many(g) else None for g in kind} if rows else {}
        names, inner = (lookup(kind, True), lookup(kind, False)) if rows else ({}, {})
        wild = next((g for g in kind if g.metadata.get("any")), None) if rows else None
        while True:
            event, name, content = events[at]
            at += 1
            if event == "EE":
                break
            if event == "AT":
                if name[:2] == NIL:
                    nil = content.strip() in ("true", "1")
                elif name[:2] == TYPE and rows and "_xsi_type" in kind.names:
                    row["_xsi_type"] = from_clark(content)[1]
                elif g := resolve(names, name[1]):
                    row[g.name] = value(g.dataType, g.metadata, content)
            elif event == "CH":
                text.append(content)
            elif event == "SE":
                g = resolve(inner, name[1])
                if g is not None and not g.metadata.get("any"):
                    got = element(item_type(g), g.metadata)
                    if many(g):
                        row[g.name].append(got)
                    else:
                        row[g.name] = got
                elif wild is not None:
                    from wirespark.sources.exi import format_xml

                    xml = format_xml(skip())
                    if isinstance(wild.dataType, T.ArrayType):
                        row[wild.name].append(xml)
                    else:
                        row[wild.name] = (row[wild.name] or "") + xml
                else:
                    skip()
        if nil:
            return None
        if not rows:
            return value(kind, meta, "".join(text))
        if "_VALUE" in kind.names:
            g = kind["_VALUE"]
            row["_VALUE"] = value(g.dataType, g.metadata, "".join(text))
        return row

    while events[at][0] != "SE":
        at += 1
    at += 1
    return element(item_type(f), f.metadata)


class Rows:
    """Documents of rows of a Spark schema: strict or not, or without a schema (informed False), where everything is text."""

    def __init__(self, schema: T.StructType, root: str, meta: dict | None = None, informed: bool = True):
        self.field = T.StructField(root, schema, False, meta or {})
        self.informed = informed
        self.schema = Schema({xml_name(self.field): self.field}) if informed else None

    def encode(self, row: Any, o: Options) -> bytes:
        return Machine(self.schema, o).encode(to_events(self.field, row, self.informed))

    def decode(self, data: bytes, o: Options) -> dict[str, Any]:
        return from_events(self.field, Machine(self.schema, o).decode(data))


def codec(schema: T.StructType, root: str, o: Options, meta: dict | None = None, informed: bool = True) -> Any:
    """The codec for rows of a schema: the short way where it can be taken."""
    from wirespark.sources.codec import Strict

    sane(o)
    if informed and not meta and o.strict and not o.lexical and not o.utc and not o.body_only and Strict.can(schema):
        return Strict(schema, root)
    return Rows(schema, root, meta, informed)


class ByRoot:
    """Documents of several kinds, told apart by their root element: {root name: schema}; rows are (root, one struct a kind)."""

    def __init__(self, schemas: dict[str, T.StructType]):
        self.fields = {name: T.StructField(name, s, False, {}) for name, s in schemas.items()}
        self.schema = Schema({xml_name(f): f for f in self.fields.values()})

    def encode(self, root: str, row: Any, o: Options) -> bytes:
        return Machine(self.schema, o).encode(to_events(self.fields[root], row))

    def decode(self, data: bytes, o: Options) -> tuple[str, dict[str, Any]]:
        events = Machine(self.schema, o).decode(data)
        root = next(name[1] for kind, name, _ in events if kind == "SE")
        if root not in self.fields:
            raise Invalid(f"no schema for {root}")
        return root, from_events(self.fields[root], events)
