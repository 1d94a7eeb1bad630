"""Which representation a type has: the defaults of built-in types, maps that change them, and types of one's own.

A representation map is resolved when a plan is made: the schema that comes out says by metadata how each field is written.
"""

from __future__ import annotations

from pyspark.sql import types as T

from wirespark.sources.wire import REPRESENTATIONS, Invalid

#: Representations of the built-in types that have one of their own.
DEFAULTS = {
    "base64Binary": "base64Binary", "hexBinary": "hexBinary", "boolean": "boolean", "dateTime": "dateTime", "time": "time", "date": "date", "gYearMonth": "gYearMonth", "gYear": "gYear", "gMonthDay": "gMonthDay", "gDay": "gDay", "gMonth": "gMonth",
    "decimal": "decimal", "float": "double", "double": "double", "integer": "integer", "string": "string", "anySimpleType": "string",
}
#: The type that a built-in type is derived from.
BASES = {
    "nonPositiveInteger": "integer", "negativeInteger": "nonPositiveInteger", "nonNegativeInteger": "integer", "positiveInteger": "nonNegativeInteger", "long": "integer", "int": "long", "short": "int", "byte": "short", "unsignedLong": "nonNegativeInteger",
    "unsignedInt": "unsignedLong", "unsignedShort": "unsignedInt", "unsignedByte": "unsignedShort", "normalizedString": "string", "token": "normalizedString", "language": "token", "Name": "token", "NMTOKEN": "token", "NCName": "Name", "ID": "NCName", "IDREF": "NCName",
    "ENTITY": "NCName", "anyURI": "anySimpleType", "QName": "anySimpleType", "NOTATION": "anySimpleType", "duration": "anySimpleType", "IDREFS": "anySimpleType", "ENTITIES": "anySimpleType", "NMTOKENS": "anySimpleType",
}
#: Integers that have a representation for their own bounds or sign, which a change for all integers leaves to them.
OWN = frozenset({"byte", "unsignedByte", "nonNegativeInteger", "positiveInteger", "unsignedLong", "unsignedInt", "unsignedShort"})
INTEGER = frozenset({"integer"})


def register(name: str, kind: T.DataType, meta: dict | None = None) -> None:
    """A representation of one's own: values are written as their text read as `kind` with `meta` has it."""
    REPRESENTATIONS[name] = (kind, meta or {})


def resolve(name: str, changes: dict[str, str], bases: dict[str, str] | None = None) -> str:
    """The representation of a type: that of the map, else that of the nearest type it is derived from which has one. Bounded and unsigned integers keep their own where the one found is that of integers."""
    known, bases, at = DEFAULTS | changes, BASES | (bases or {}), name
    while at not in known:
        if at not in bases:
            raise Invalid(f"no type {name}")
        at = bases[at]
    return name if known[at] in INTEGER and at != name and name in OWN else known[at]


def type_name(kind: T.DataType, meta: dict) -> str:
    """The built-in type that a field has."""
    if "xsd" in meta:
        return meta["xsd"]
    if isinstance(kind, T.IntegralType):
        return "unsignedLong" if meta.get("unsigned") else "byte" if (meta.get("min"), meta.get("max")) == (-128, 127) else "unsignedByte" if (meta.get("min"), meta.get("max")) == (0, 255) else "integer"
    names = ((T.BooleanType, "boolean"), (T.DecimalType, "decimal"), ((T.DoubleType, T.FloatType), "double"), (T.BinaryType, "base64Binary" if meta.get("base64") else "hexBinary"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "dateTime"))
    return next((n for k, n in names if isinstance(kind, k)), "string")


def represented(schema: T.StructType, changes: dict[str, str]) -> T.StructType:
    """A schema whose fields are written as a map from types to representations says. A map for an enumeration's or a union's base doesn't reach it (members keep their codes, unions of strings stay strings); a list's items change."""

    def of(kind: T.DataType, meta: dict) -> tuple[T.DataType, dict]:
        if isinstance(kind, T.StructType):
            return represented(kind, changes), meta
        if isinstance(kind, T.ArrayType):
            inner, meta = of(kind.elementType, meta)
            return T.ArrayType(inner, kind.containsNull), meta
        name = type_name(kind, meta)
        now = resolve(name, changes)
        if meta.get("enum") or now in (name, DEFAULTS.get(name)):
            return kind, meta
        if now == "estring":
            return kind, {**meta, "extended": list(meta.get("likely", []))}
        return kind, {k: v for k, v in meta.items() if k not in ("min", "max", "unsigned", "xsd")} | {"represent": now}

    fields = []
    for f in schema:
        kind, meta = of(f.dataType, f.metadata)
        fields.append(T.StructField(f.name, kind, f.nullable, meta))
    return T.StructType(fields)
