"""Grammars made from Spark schemas: which events may come in which state of an element, in the order of their codes.

A struct is an element type. Its fields that start with `_` are attributes, `_VALUE` is text beside attributes, the others are
child elements in order; an array repeats its element, a nullable field is optional, a field of a simple type is an
element with typed text. Metadata of a field:

    name, ns         XML name (else the field's) and namespace (else none)
    nillable         null is an element with xsi:nil (of an array's items, too)
    types            {type name: [fields]}: named types of a struct, told by xsi:type; `_xsi_type` holds the name, fields that no
                     type names are common to all
    any              an element wildcard (true, or a list of namespaces), any number of elements, or one with `once`;
                     any_attribute: the same for attributes of a struct
    mixed            text between child elements
    enum, min, max, unsigned, charset, lexical, list, xsd, pattern, extended   forms of values, see wire.write_value
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

from wirespark.sources.wire import EXI_NS, GIVEN, XSD_NS, Name

#: Events of productions, in the order of their codes.
RANK = ("AT", "AT-NS", "AT-ANY", "SE", "SE-NS", "SE-ANY", "EE", "CH", "CH-ANY")
#: The names of built-in simple types, in the order of their table.
XSD_NAMES = (
    "ENTITIES ENTITY ID IDREF IDREFS NCName NMTOKEN NMTOKENS NOTATION Name QName anySimpleType anyType anyURI base64Binary boolean byte date dateTime decimal double duration float gDay gMonth gMonthDay gYear gYearMonth hexBinary "
    "int integer language long negativeInteger nonNegativeInteger nonPositiveInteger normalizedString positiveInteger short string time token unsignedByte unsignedInt unsignedLong unsignedShort"
).split()
#: Names of the representations that a datatype representation map can name.
EXI_TYPES = "base64Binary boolean date dateTime decimal double gDay gMonth gMonthDay gYear gYearMonth hexBinary ieeeBinary32 ieeeBinary64 integer string time".split()
ANY_TYPE = "xsd:anyType"


class Production(NamedTuple):
    """An event that may come, and the state that follows in the same type (None: the element ends)."""

    event: str
    name: Name | None = None
    kind: T.DataType | None = None
    meta: dict | None = None
    type: str | None = None
    next: int | None = None


class ElementType:
    """States of an element: FIRST, right after its start; 0 to n, the next of n attributes; CONTENT + 2 i, before child i, and one more if child i has begun and may go on; DONE, after typed text."""

    FIRST, CONTENT, DONE = -1, 1000, 999

    def __init__(self, name: str, nillable: bool = False, castable: bool = False, empty: str | None = None):
        self.name, self.nillable, self.castable, self.empty, self.states = name, nillable, castable, empty, {}

    def phase(self, state: int) -> str:
        return "first" if state == self.FIRST else "start" if state < self.DONE else "content"


def xml_name(f: T.StructField, attribute: bool = False) -> Name:
    return f.metadata.get("ns", ""), f.metadata.get("name") or (f.name[1:] if attribute else f.name)


def is_attribute(f: T.StructField) -> bool:
    return f.name.startswith("_") and f.name not in ("_VALUE", "_xsi_type")


def many(f: T.StructField) -> bool:
    """Whether a field is a repeated element; an array marked as a list is one element with a list for its content."""
    return isinstance(f.dataType, T.ArrayType) and not f.metadata.get("list")


def repeats(f: T.StructField) -> bool:
    return many(f) or bool(f.metadata.get("any") and not f.metadata.get("once"))


def item_type(f: T.StructField) -> T.DataType:
    return f.dataType.elementType if many(f) else f.dataType


#: Spark's types of built-in simple types, for xsi:type.
BUILT_IN: dict[str, tuple[T.DataType, dict]] = {
    **{n: (T.LongType(), {}) for n in ("int", "integer", "long", "short", "negativeInteger", "nonPositiveInteger")}, **{n: (T.LongType(), {"unsigned": True}) for n in ("nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong", "unsignedShort")},
    "byte": (T.LongType(), {"min": -128, "max": 127}), "unsignedByte": (T.LongType(), {"min": 0, "max": 255}), "boolean": (T.BooleanType(), {}), "decimal": (T.DecimalType(38, 18), {"plain": True}), "double": (T.DoubleType(), {}), "float": (T.DoubleType(), {}),
    "hexBinary": (T.BinaryType(), {}), "base64Binary": (T.BinaryType(), {"base64": True}), **{n: (T.StringType(), {"xsd": n}) for n in ("date", "dateTime", "time", "gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth")},
}


class Schema:
    """Grammars of documents with one of some root elements, and the names that its tables start with."""

    def __init__(self, roots: dict[Name, T.StructField], attributes: dict[Name, T.StructField] | None = None, more_names: dict[str, list[str]] | None = None):
        self.types: dict[str, ElementType] = {}
        self.named: dict[Name, str] = {}
        self.roots = {name: self._element(f, name[1]) for name, f in sorted(roots.items(), key=lambda r: (r[0][1], r[0][0]))}
        self.attributes = {name: (f.dataType, f.metadata) for name, f in (attributes or {}).items()}
        self._built_in()
        self.elements = dict(self.roots)
        names = {u: set() for u in GIVEN} | {u: set(v) for u, v in (more_names or {}).items()}
        for uri, local in [*self.roots, *self.attributes, *self.named, *(p.name for t in self.types.values() for ways in t.states.values() for p in ways if p.name)]:
            names.setdefault(uri, set()).add(local)
        names.pop(XSD_NS, None)
        given = {u: sorted(set(v) | names.pop(u, set())) for u, v in GIVEN.items()}
        self.names: dict[str, list[str]] = given | {XSD_NS: list(XSD_NAMES)} | {u: sorted(v) for u, v in sorted(names.items())}
        #: elements by name, for fragments
        declared = {p.name: p.type for t in self.types.values() for ways in t.states.values() for p in ways if p.event == "SE"}
        self.fragment = dict(sorted((declared | self.roots).items(), key=lambda r: (r[0][1], r[0][0])))

    @classmethod
    def of(cls, schema: T.StructType, root: str, meta: dict | None = None) -> Schema:
        f = T.StructField(root, schema, False, meta or {})
        return cls({xml_name(f): f})

    def _element(self, f: T.StructField, path: str) -> str:
        """The type of a field's element, made once for each path."""
        kind, meta = item_type(f), f.metadata
        types = meta.get("types") or {}
        if path not in self.types:
            listed = {c for own in types.values() for c in own}
            common = T.StructType([g for g in kind if g.name not in listed]) if types else kind
            self._add(path, common, meta, bool(types))
            for name, own in types.items():
                whole = T.StructType([g for g in kind if g.name not in listed or g.name in own])
                self._add(f"{path}:{name}", whole, meta, False)
                self.named[meta.get("ns", ""), name] = f"{path}:{name}"
        return path

    def _add(self, path: str, kind: T.DataType, meta: dict, castable: bool) -> None:
        t = self.types[path] = ElementType(path, bool(meta.get("nillable")), castable, f"{path}#nil")
        fields = list(kind) if isinstance(kind, T.StructType) else []
        attributes = sorted((f for f in fields if is_attribute(f)), key=lambda f: xml_name(f, True)[::-1])
        text = next((f for f in fields if f.name == "_VALUE"), None)
        simple = (text.dataType, text.metadata) if text else None if isinstance(kind, T.StructType) else (kind, meta)
        children = [f for f in fields if not f.name.startswith("_")]
        wild = meta.get("any_attribute")
        wilds = [("AT-ANY", None)] if wild is True else [("AT-NS", (ns, "")) for ns in wild or ()]

        def content(i: int, again: bool) -> list[Production]:
            if simple:
                return [Production("CH", None, *simple, None, t.DONE)]
            out = []
            for k in range(i, len(children)):
                f = children[k]
                after = t.CONTENT + 2 * k + 1 if repeats(f) else t.CONTENT + 2 * (k + 1)
                if f.metadata.get("any"):
                    out += [Production("SE-ANY", next=after)] if f.metadata["any"] is True else [Production("SE-NS", (ns, ""), next=after) for ns in f.metadata["any"]]
                else:
                    out.append(Production("SE", xml_name(f), type=self._element(f, f"{path}/{f.name}"), next=after))
                if not (f.nullable or repeats(f) or (again and k == i)):
                    break
            else:
                out.append(Production("EE"))
            if meta.get("mixed"):
                out.append(Production("CH-ANY", next=t.CONTENT + 2 * i + again))
            return out

        def start(i: int, inside) -> list[Production]:
            out = [Production(event, name, next=i) for event, name in wilds]
            for k in range(i, len(attributes)):
                f = attributes[k]
                out.append(Production("AT", xml_name(f, True), f.dataType, f.metadata, None, k + 1))
                if not f.nullable:
                    return out
            return out + inside()

        def put(of: ElementType, state: int, ways: list[Production]) -> None:
            of.states[state] = sorted(ways, key=lambda p: RANK.index(p.event))

        empty = self.types[t.empty] = ElementType(t.empty, empty=t.empty)
        for i in range(len(attributes) + 1):
            put(t, i, start(i, lambda: content(0, False)))
            put(empty, i, start(i, lambda: [Production("EE")]))
        for i in range(len(children) + 1):
            put(t, t.CONTENT + 2 * i, content(i, False))
            if i < len(children) and repeats(children[i]):
                put(t, t.CONTENT + 2 * i + 1, content(i, True))
        put(t, t.DONE, [Production("EE")])
        put(empty, t.CONTENT, [Production("EE")])
        for x in (t, empty):
            x.states[x.FIRST] = x.states[0]

    def _built_in(self) -> None:
        t = self.types[ANY_TYPE] = ElementType(ANY_TYPE, empty=f"{ANY_TYPE}#nil")
        empty = self.types[t.empty] = ElementType(t.empty, empty=t.empty)
        inside = [Production("SE-ANY", next=t.CONTENT), Production("EE"), Production("CH-ANY", next=t.CONTENT)]
        t.states = {s: [Production("AT-ANY", next=0), *inside] for s in (t.FIRST, 0)} | {t.CONTENT: inside}
        empty.states = {s: [Production("AT-ANY", next=0), Production("EE")] for s in (t.FIRST, 0)} | {t.CONTENT: [Production("EE")]}
        for name in XSD_NAMES:
            if name == "anyType":
                self.named[XSD_NS, name] = ANY_TYPE
            else:
                kind, meta = BUILT_IN.get(name, (T.StringType(), {}))
                self._add(f"xsd:{name}", kind, meta, False)
                self.named[XSD_NS, name] = f"xsd:{name}"


def second_level(grammar: str, has_end: bool, o, castable: bool = False, nillable: bool = False) -> list[str]:
    """Events behind the first level's escape, in the order of their codes; CM/PI: a third level. grammar: first, start or content (of a schema), built-in start or built-in content, document, fragment, end."""
    misc = ["CM/PI"] * bool(o.comments or o.pis)
    if grammar == "document":
        return ["DT"] * o.dtd + misc
    if grammar in ("fragment", "end"):
        return misc
    if grammar in ("first", "start", "content") and o.strict:
        return (["xsi:type", "xsi:nil"] if castable else ["xsi:nil"] * nillable) if grammar == "first" else []
    ends, inner = ["EE"] * (not has_end), ["SE", "CH"] + ["ER"] * o.dtd + misc
    if grammar == "first":
        return ends + ["xsi:type", "xsi:nil", "AT", "AT-BAD"] + ["NS"] * o.prefixes + ["SC"] * o.self_contained + inner
    if grammar == "start":
        return ends + ["AT", "AT-BAD"] + inner
    if grammar == "built-in start":
        return ["EE", "AT"] + ["NS"] * o.prefixes + ["SC"] * o.self_contained + inner
    return inner if grammar == "built-in content" else ends + inner


def third_level(o) -> list[str]:
    return ["CM"] * o.comments + ["PI"] * o.pis


def _flag(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StructType([]), True, {"ns": EXI_NS}) for n in names])


def _options_schema() -> Schema:
    """The schema of the options document."""
    f = lambda name, kind, nullable=True, **meta: T.StructField(name, kind, nullable, {"ns": EXI_NS, **meta})
    pair = T.StructType([f("first", T.StringType(), False, any=True, once=True), f("second", T.StringType(), False, any=True, once=True)])
    uncommon = T.StructType([
        f("other", T.StringType(), any=True), f("alignment", _flag("byte", "pre-compress")), f("selfContained", T.StructType([])), f("valueMaxLength", T.LongType(), unsigned=True), f("valuePartitionCapacity", T.LongType(), unsigned=True),
        f("datatypeRepresentationMap", T.ArrayType(pair)),
    ])
    less = T.StructType([f("uncommon", uncommon), f("preserve", _flag("dtd", "prefixes", "lexicalValues", "comments", "pis")), f("blockSize", T.LongType(), unsigned=True)])
    common = T.StructType([f("compression", T.StructType([])), f("fragment", T.StructType([])), f("schemaId", T.StringType(), nillable=True)])
    header = T.StructType([f("lesscommon", less), f("common", common), f("strict", T.StructType([]))])
    return Schema({(EXI_NS, "header"): f("header", header, False)}, more_names={EXI_NS: EXI_TYPES})


OPTIONS = _options_schema()
