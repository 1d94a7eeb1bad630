"""Codecs of one document: strict ones straight from rows, and what wire.py, schema.py and machine.py have."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from wirespark.sources.machine import Machine, SchemaLess, clark, read_header, sane, write_header
from wirespark.sources.schema import OPTIONS, Schema, is_attribute, item_type, many, second_level, third_level, xml_name
from wirespark.sources.wire import CHARSETS, COOKIE, EXI_NS, GIVEN, XML_NS, XSD_NS, XSI_NS, BitReader, BitWriter, Event, Invalid, Name, Options, Strings, checked, read_value, value_of, width, write_value

__all__ = [
    "CHARSETS", "COOKIE", "EXI_NS", "GIVEN", "OPTIONS", "XML_NS", "XSD_NS", "XSI_NS", "BitReader", "BitWriter", "Event", "Invalid", "Machine", "Name", "Options", "Schema", "SchemaLess", "Strict", "Strings", "checked", "read_header", "read_value", "sane", "second_level",
    "third_level", "value_of", "width", "write_header", "write_value",
]


class Strict:
    """Strict documents of one root element, straight from and to nested rows: the short way for schemas without namespaces, wildcards, nil and named types; the bits are those of Machine.

    A null array is no elements, and is read as an empty one.
    """

    def __init__(self, schema: T.StructType, root: str):
        self.schema, self.root, self.plans = schema, root, {}

    @staticmethod
    def can(schema: T.DataType) -> bool:
        """Whether a schema is one of these."""
        if isinstance(schema, T.ArrayType):
            return Strict.can(schema.elementType)
        if not isinstance(schema, T.StructType):
            return True
        special = {"types", "any", "any_attribute", "mixed", "nillable"}
        return all(not special & set(f.metadata) and f.name not in ("_VALUE", "_xsi_type") and Strict.can(f.dataType) for f in schema)

    def encode(self, row: dict, o: Options | None = None) -> bytes:
        o = o or Options(strict=True)
        out = BitWriter(o.byte_aligned)
        write_header(out, o)
        self.write_body(out, row, o.strings())
        return out.done()

    def decode(self, data: bytes, o: Options | None = None) -> dict:
        source, o = read_header(data, o or Options(strict=True))
        return self.read_body(source, o.strings())

    def write_body(self, out: BitWriter, row: dict, strings: Strings) -> None:
        out.nbit(0, 1)  # the root, or any other element
        self._write(out, strings, self.schema, row)

    def read_body(self, source: BitReader, strings: Strings) -> dict:
        if source.nbit(1):
            raise Invalid("a root element that the schema lacks")
        return self._read(source, strings, self.schema)

    @staticmethod
    def _particles(schema: T.StructType) -> list[T.StructField]:
        """Attributes by name, then elements in order."""
        return [*sorted((f for f in schema if f.name.startswith("_")), key=lambda f: f.name[1:]), *(f for f in schema if not f.name.startswith("_"))]

    @staticmethod
    def _next(fields: list[T.StructField], at: int, again: bool) -> list[int]:
        """Places that may come now, the end (as len(fields)) last; again: the array at `at` has begun and may go on or stop."""
        out = []
        for i in range(at, len(fields)):
            out.append(i)
            if not (fields[i].nullable or many(fields[i]) or (again and i == at)):
                return out
        return [*out, len(fields)]

    def _of(self, schema: T.StructType) -> _Plan:
        if id(schema) not in self.plans:
            self.plans[id(schema)] = _Plan(schema)
        return self.plans[id(schema)]

    def _write(self, out: BitWriter, strings: Strings, schema: T.StructType, row: Any) -> None:
        plan, at, again = self._of(schema), 0, False
        for i, p in enumerate(plan.particles):
            value = row.get(p.name)
            if value is None:
                continue
            for item in value if p.many else (value,):
                if item is None:
                    raise Invalid(f"an item of {p.name} is null, and the field isn't nillable")
                code, size = plan.code(at, again, i)
                if size:
                    out.nbit(code, size)
                if p.plan:
                    self._write(out, strings, p.kind, item if isinstance(item, dict) else item.asDict())
                else:
                    write_value(out, strings, p.context, p.kind, item, p.meta)
                at, again = (i, True) if p.many else (i + 1, False)
        code, size = plan.code(at, again, len(plan.particles))
        if size:
            out.nbit(code, size)

    def _read(self, source: BitReader, strings: Strings, schema: T.StructType) -> dict:
        plan, at, again = self._of(schema), 0, False
        row: dict = plan.empty()
        while True:
            ways, size = plan.ways(at, again)
            k = source.nbit(size)
            if k >= len(ways):
                raise Invalid(f"no event {k} of {len(ways)}")
            i = ways[k]
            if i == len(plan.particles):
                return row
            p = plan.particles[i]
            value = self._read(source, strings, p.kind) if p.plan else read_value(source, strings, p.context, p.kind, p.meta)
            if p.many:
                row[p.name].append(value)
            else:
                row[p.name] = value
            at, again = (i, True) if p.many else (i + 1, False)


class _Particle:
    __slots__ = ("context", "kind", "many", "meta", "name", "plan")

    def __init__(self, f: T.StructField):
        self.name, self.many, self.kind, self.meta = f.name, many(f), item_type(f), f.metadata
        self.context, self.plan = clark(xml_name(f, is_attribute(f))), isinstance(self.kind, T.StructType)


class _Plan:
    """What a struct's documents need over and over, made once."""

    def __init__(self, schema: T.StructType):
        self.schema, self.fields = schema, Strict._particles(schema)
        self.particles, self._ways = [_Particle(f) for f in self.fields], {}
        self._arrays = [(f.name, many(f)) for f in schema]

    def empty(self) -> dict:
        return {name: [] if several else None for name, several in self._arrays}

    def ways(self, at: int, again: bool) -> tuple[list[int], int]:
        if (at, again) not in self._ways:
            ways = Strict._next(self.fields, at, again)
            self._ways[at, again] = ways, width(len(ways))
        return self._ways[at, again]

    def code(self, at: int, again: bool, to: int) -> tuple[int, int]:
        ways, size = self.ways(at, again)
        if to not in ways:
            raise Invalid(f"{self.fields[at].name} is missing")
        return ways.index(to), size
