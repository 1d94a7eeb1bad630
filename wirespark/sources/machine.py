"""Documents as events: a fold over one document's events or bits, with the grammars of a schema, with learning ones, or both.

Elements that a schema declares follow its grammars; others, and all where there is no schema, learn from the document. Not
strict: whatever a grammar lacks is behind its second level. Events: SE, AT, CH, EE, and, if their option is on, CM, PI, DT
(name; public, system and internal subset joined by NUL), ER (name), NS (namespace and prefix; value "true" if the element
around has that prefix) and SC (right after an SE: the element is byte-aligned with tables of its own, and its bytes' length
goes before it, so that a reader can pass over it). Names are (namespace, local), with a third part, the prefix, where
prefixes are kept. Values are text; that of xsi:type is a name as {namespace}local.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from wirespark.sources.schema import OPTIONS, ElementType, Production, Schema, second_level, third_level
from wirespark.sources.wire import COOKIE, EXI_NS, GIVEN, XML_NS, XSD_NS, XSI_NS, BitReader, BitWriter, Event, Invalid, Name, Options, _charset, checked, read_value, text_of, width, write_value

TYPE, NIL = (XSI_NS, "type"), (XSI_NS, "nil")
STRING = T.StringType()
#: The schema id of a document that is said to have no schema.
NO_SCHEMA = "xsi:nil"
SECOND = {"SE": "SE", "AT": "AT", "CH": "CH", "EE": "EE", "CM": "CM/PI", "PI": "CM/PI", "ER": "ER", "SC": "SC", "NS": "NS", "DT": "DT"}


def clark(name: Name) -> str:
    return f"{{{name[0]}}}{name[1]}"


def from_clark(text: str) -> Name:
    if text.startswith("{") and "}" in text:
        uri, _, local = text[1:].partition("}")
        return uri, local
    return "", text


class Names:
    """URI, prefix and local name tables of one document."""

    def __init__(self, schema: Schema | None):
        self.uris = {u: list(v) for u, v in (schema.names if schema else GIVEN).items()}
        self.prefixes = {"": [""], XML_NS: ["xml"], XSI_NS: ["xsi"]}

    def write_uri(self, out: BitWriter, uri: str) -> None:
        order = list(self.uris)
        w = width(len(order) + 1)
        if uri in self.uris:
            out.nbit(order.index(uri) + 1, w)
        else:
            out.nbit(0, w)
            out.string(uri)
            self.uris[uri] = []

    def read_uri(self, source: BitReader) -> str:
        order = list(self.uris)
        i = source.nbit(width(len(order) + 1))
        if i > len(order):
            raise Invalid("no such URI")
        uri = order[i - 1] if i else source.string()
        self.uris.setdefault(uri, [])
        return uri

    def write_local(self, out: BitWriter, uri: str, local: str) -> None:
        names = self.uris[uri]
        if local in names:
            out.unsigned(0)
            out.nbit(names.index(local), width(len(names)))
        else:
            out.string(local, 1)
            names.append(local)

    def read_local(self, source: BitReader, uri: str) -> str:
        names = self.uris[uri]
        n = source.unsigned()
        if n:
            names.append(source.chars(n - 1))
            return names[-1]
        k = source.nbit(width(len(names)))
        if k >= len(names):
            raise Invalid("no such name")
        return names[k]

    def write(self, out: BitWriter, name: Name) -> None:
        self.write_uri(out, name[0])
        self.write_local(out, name[0], name[1])

    def read(self, source: BitReader) -> Name:
        uri = self.read_uri(source)
        return uri, self.read_local(source, uri)

    def write_prefix(self, out: BitWriter, uri: str, prefix: str | None) -> None:
        """A name's prefix: no bits if there is no choice; an unknown one is told by the NS event that must follow."""
        known = self.prefixes.get(uri, [])
        if uri and len(known) > 1:
            out.nbit(known.index(prefix) if prefix in known else 0, width(len(known)))

    def read_prefix(self, source: BitReader, uri: str) -> str | None:
        known = self.prefixes.get(uri, [])
        if not uri:
            return ""
        if not known:
            return None
        i = source.nbit(width(len(known)))
        if i >= len(known):
            raise Invalid("no such prefix")
        return known[i]

    def write_declared(self, out: BitWriter, uri: str, prefix: str) -> None:
        known = self.prefixes.setdefault(uri, [])
        w = width(len(known) + 1)
        if prefix in known:
            out.nbit(known.index(prefix) + 1, w)
        else:
            out.nbit(0, w)
            out.string(prefix)
            known.append(prefix)

    def read_declared(self, source: BitReader, uri: str) -> str:
        known = self.prefixes.setdefault(uri, [])
        i = source.nbit(width(len(known) + 1))
        if i > len(known):
            raise Invalid("no such prefix")
        if not i:
            known.append(source.string())
            return known[-1]
        return known[i - 1]


END = Production("EE")


class Learned:
    """The learned productions of an element without a declared type, the newest with code 0."""

    def __init__(self, may: bool):
        self.may, self.start, self.content = may, [], [END]

    def of(self, started: bool) -> list[Production]:
        return self.start if started else self.content


class Frame:
    """An open element: its name, its type and state (type None: learned productions; state: still in its start tag)."""

    __slots__ = ("learned", "name", "scope", "state", "type")

    def __init__(self, name: Name, kind: ElementType | None, learned: Learned | None):
        self.name, self.type, self.learned, self.scope = name, kind, learned, {}
        self.state: Any = kind.FIRST if kind else True

    def ways(self) -> list[Production]:
        return self.type.states[self.state] if self.type else self.learned.of(self.state)

    def grammar(self) -> str:
        return self.type.phase(self.state) if self.type else "built-in start" if self.state else "built-in content"

    def switch(self, kind: ElementType) -> None:
        self.type, self.learned, self.state = kind, None, kind.FIRST

    def to_content(self) -> None:
        if not self.type:
            self.state = False
        elif self.type.phase(self.state) != "content":
            self.state = self.type.CONTENT


class Machine:
    def __init__(self, schema: Schema | None = None, o: Options | None = None):
        self.schema, self.o = schema, o or Options()
        self.third, self.second = third_level(self.o), {}

    def begin(self) -> None:
        self.names, self.strings, self.elements, self.learned = Names(self.schema), self.o.strings(), {}, 0
        self.frames: list[Frame] = []
        self.ended, self.outer = False, []  # outer: learned elements of a fragment

    # what writer and reader share

    def _frame(self, name: Name, kind: str | None) -> Frame:
        """A new element, of the type its production names, of a global element, or learned."""
        kind = kind or (self.schema.elements.get(name) if self.schema else None)
        if kind:
            return Frame(name, self.schema.types[kind], None)
        if name not in self.elements:
            self.elements[name] = Learned(not (self.schema and 0 <= self.o.max_grammars <= len(self.elements)))
        return Frame(name, None, self.elements[name])

    def _learn(self, f: Frame, p: Production) -> None:
        # without a schema there are no limits
        if f.type or not f.learned.may or (self.schema and 0 <= self.o.max_productions <= self.learned):
            return
        at = f.learned.of(f.state)
        if p not in at:
            at.insert(0, p)
            self.learned += 1

    def _outside(self) -> tuple[list[Production], list[str]]:
        """First and second level outside the root."""
        if self.o.fragment:
            known = [Production("SE", n, type=t) for n, t in self.schema.fragment.items()] if self.schema else [Production("SE", n) for n in reversed(self.outer)]
            return [*known, Production("SE-ANY"), Production("ED")], second_level("fragment", False, self.o)
        if self.ended:
            return [Production("ED")], second_level("end", False, self.o)
        known = [Production("SE", n, type=t) for n, t in self.schema.roots.items()] if self.schema else []
        return [*known, Production("SE-ANY")], second_level("document", False, self.o)

    def _second(self, f: Frame, ways: list[Production]) -> list[str]:
        t = f.type
        key = f.grammar(), any(p.event == "EE" for p in ways), bool(t and t.castable), bool(t and t.nillable)
        if key not in self.second:
            self.second[key] = second_level(key[0], key[1], self.o, *key[2:])
        return self.second[key]

    def _type_of(self, name: Name) -> ElementType | None:
        kind = self.schema.named.get(name) if self.schema else None
        return self.schema.types[kind] if kind else None

    def _meta(self, p: Production) -> dict:
        return {**(p.meta or {}), "utc": True} if self.o.utc else p.meta or {}

    def _closed(self) -> None:
        self.frames.pop()
        if not self.frames:
            self.ended = True

    # writing

    def encode(self, events: list[Event]) -> bytes:
        """Events of a document's root and what surrounds it, without SD and ED."""
        sane(self.o)
        out = BitWriter(self.o.byte_aligned)
        if not self.o.body_only:
            write_header(out, self.o)
        self.begin()
        self.write(out, events)
        return out.done()

    def write(self, out: BitWriter, events: list[Event]) -> None:
        o = self.o
        dropped = {k for k, on in (("CM", o.comments), ("PI", o.pis), ("DT", o.dtd), ("ER", o.dtd), ("SC", o.self_contained), ("NS", o.prefixes)) if not on}
        i = 0
        while i < len(events):
            kind, name, value = events[i]
            i += 1
            if kind == "NS" and self.frames:
                self.frames[-1].scope[name[1]] = name[0]
            if kind in dropped:
                continue
            if kind == "SC":
                i = self._write_contained(out, events, i)
                continue
            self._limit(out, kind, name, events[i - 2][0] if i > 1 else None)
            getattr(self, f"_write_{kind.lower()}")(out, name, value)
        if self.frames:
            raise Invalid("the root isn't closed")
        self._code(out, *self._outside(), event="ED")

    def _code(self, out: BitWriter, ways: list[Production], second: list[str], at: int | None = None, event: str | None = None, behind: bool = False) -> None:
        """The code of production `at`, of the first one with an event (not if `behind`), or of an event behind the escape."""
        if at is None and not behind:
            at = next((k for k, p in enumerate(ways) if p.event == event and p.name is None), None)
        w = width(len(ways) + bool(second))
        if at is not None:
            out.nbit(at, w)
            return
        group = SECOND.get(event, event)
        if group not in second:
            raise Invalid(f"{event} isn't allowed here")
        out.nbit(len(ways), w)
        out.nbit(second.index(group), width(len(second)))
        if group == "CM/PI":
            out.nbit(self.third.index(event), width(len(self.third)))

    def _find(self, ways: list[Production], event: str, name: Name) -> int | None:
        """The production for an event's name: by name, by namespace, any."""
        found, own, best = None, name[:2], 3
        for k, p in enumerate(ways):
            if p.event == event:
                if p.name == own:
                    return k
            elif best > 1 and p.event == f"{event}-NS" and p.name[0] == own[0]:
                found, best = k, 1
            elif best > 2 and p.event == f"{event}-ANY":
                found, best = k, 2
        return found

    def _write_name(self, out: BitWriter, p: Production | None, name: Name) -> None:
        """What a production leaves open of a name."""
        if p is None or p.event.endswith("-ANY"):
            self.names.write(out, name)
        elif p.event.endswith("-NS"):
            self.names.write_local(out, name[0], name[1])
        if self.o.prefixes:
            self.names.write_prefix(out, name[0], name[2] if len(name) > 2 else None)

    def _write_se(self, out: BitWriter, name: Name, value: Any) -> None:
        inside = bool(self.frames)
        ways, second = self._outside() if not inside else (self.frames[-1].ways(), [])
        if inside:
            second = self._second(self.frames[-1], ways)
        k = self._find(ways, "SE", name)
        p = ways[k] if k is not None else None
        self._code(out, ways, second, k, "SE")
        self._write_name(out, p, name)
        self._after_se(p, name[:2])

    def _after_se(self, p: Production | None, name: Name) -> None:
        if not self.frames:
            if self.o.fragment and not self.schema and name not in self.outer:
                self.outer.append(name)
        else:
            f = self.frames[-1]
            if p is None:
                self._learn(f, Production("SE", name))
            if p is not None and f.type:
                f.state = p.next
            else:
                f.to_content()
        self.frames.append(self._frame(name, p.type if p else None))

    def _write_ee(self, out: BitWriter, name: Name | None, value: Any) -> None:
        f = self.frames[-1]
        ways = f.ways()
        second = self._second(f, ways)
        if "EE" not in second and not any(p.event == "EE" for p in ways):
            self._write_ch(out, None, "")  # strict: empty text isn't told
            return self._write_ee(out, name, value)
        known = any(p.event == "EE" for p in ways)
        self._code(out, ways, second, event="EE")
        if not known:
            self._learn(f, Production("EE"))
        self._closed()
        return None

    def _write_at(self, out: BitWriter, name: Name, value: Any) -> None:
        f = self.frames[-1]
        ways = f.ways()
        second = self._second(f, ways)
        if name[:2] == TYPE:
            return self._write_type(out, f, ways, second, name, value)
        if name[:2] == NIL and f.type:
            return self._write_nil(out, f, ways, second, name, value)
        k = self._find(ways, "AT", name)
        p = ways[k] if k is not None else None
        declared = [q for q in ways if q.event == "AT"]
        kind, meta = (p.kind, self._meta(p)) if p and p.kind else self.schema.attributes.get(name[:2], (STRING, {})) if self.schema and f.type else (STRING, {})
        typed = self._valid(kind, meta, value)
        if typed is None and f.type:
            if "AT-BAD" not in second:
                raise Invalid(f"{value!r} for {name[1]}")
            self._code(out, ways, second, event="AT-BAD")
            out.nbit(declared.index(p) if p in declared else len(declared), width(len(declared) + 1))
            if p not in declared:
                self._write_name(out, None, name)
            elif self.o.prefixes:
                self._write_name(out, p, name)
            self._text(out, name, value)
        else:
            self._code(out, ways, second, k, "AT")
            self._write_name(out, p, name)
            if p is None:
                self._learn(f, Production("AT", name[:2]))
            self._value(out, name, kind, meta, typed)
        if p is not None and f.type:
            f.state = p.next
        return None

    def _valid(self, kind: T.DataType, meta: dict, value: Any) -> Any:
        """The value as its type takes it, None if it doesn't."""
        if self.o.lexical:
            return value
        try:
            return checked(kind, meta, value)
        except (Invalid, ValueError, TypeError):
            return None

    def _value(self, out: BitWriter, name: Name, kind: T.DataType, meta: dict, value: Any) -> None:
        if self.o.lexical:
            self.strings.write(out, clark(name), value if isinstance(value, str) else text_of(kind, value), _charset(kind))
        else:
            write_value(out, self.strings, clark(name), kind, value, meta)

    def _text(self, out: BitWriter, name: Name, value: Any) -> None:
        from wirespark.sources.rows import plain_text

        self.strings.write(out, clark(name), value if isinstance(value, str) else plain_text(value))

    def _write_type(self, out: BitWriter, f: Frame, ways: list[Production], second: list[str], name: Name, value: str) -> None:
        if "xsi:type" in second:
            self._code(out, ways, second, event="xsi:type")
            if self.o.prefixes:
                self.names.write_prefix(out, XSI_NS, name[2] if len(name) > 2 else None)
        else:
            k = self._find(ways, "AT", TYPE)
            p = ways[k] if k is not None else None
            self._code(out, ways, second, k, "AT")
            self._write_name(out, p, name)
            if p is None:
                self._learn(f, Production("AT", TYPE))
        kind = from_clark(value)
        prefix = next((x for fr in reversed(self.frames) for x, u in fr.scope.items() if u == kind[0]), None)
        if self.o.lexical:
            self._text(out, TYPE, f"{prefix}:{kind[1]}" if prefix else value)
        else:
            self.names.write(out, kind)
            if self.o.prefixes:
                self.names.write_prefix(out, kind[0], prefix)
        if t := self._type_of(kind):
            f.switch(t)

    def _write_nil(self, out: BitWriter, f: Frame, ways: list[Production], second: list[str], name: Name, value: Any) -> None:
        nil = self._valid(T.BooleanType(), {}, value) if not self.o.lexical else {"true": True, "1": True}.get(str(value).strip().lower(), False)
        if nil is False and not self.o.lexical and not self.o.keep_nil:
            return
        if nil is None:
            self._code(out, ways, second, event="AT-BAD")
            n = sum(p.event == "AT" for p in ways)
            out.nbit(n, width(n + 1))
            self._write_name(out, None, name)
            self._text(out, NIL, value)
            return
        if "xsi:nil" in second:
            self._code(out, ways, second, event="xsi:nil")
            if self.o.prefixes:
                self.names.write_prefix(out, XSI_NS, name[2] if len(name) > 2 else None)
        else:
            k = self._find(ways, "AT", NIL)
            if k is None:
                raise Invalid("xsi:nil isn't allowed here")
            self._code(out, ways, second, k)
            self._write_name(out, ways[k], name)
        self._value(out, NIL, T.BooleanType(), {}, value if self.o.lexical else nil)
        if nil:
            f.switch(self.schema.types[f.type.empty])

    def _write_ch(self, out: BitWriter, name: Name | None, value: Any) -> None:
        if not self.frames:
            return
        f = self.frames[-1]
        ways = f.ways()
        second = self._second(f, ways)
        k = next((k for k, p in enumerate(ways) if p.event == "CH" and f.type), None)
        if k is not None:
            p = ways[k]
            typed = self._valid(p.kind, self._meta(p), value)
            if typed is None and value == "" and isinstance(p.kind, T.ArrayType):
                typed = []
            if typed is not None:
                self._code(out, ways, second, k)
                self._value(out, f.name, p.kind, self._meta(p), typed)
                f.state = p.next
                return
        k = next((k for k, p in enumerate(ways) if p.event == "CH-ANY" or (p.event == "CH" and not f.type)), None)
        if k is not None:
            p = ways[k]
            self._code(out, ways, second, k)
            self._text(out, f.name, value)
            if f.type:
                f.state = p.next
            else:
                f.to_content()
            return
        if "CH" not in second and not str(value).strip(" \t\r\n") and value != "":
            return  # strict: white space between elements has no place
        self._code(out, ways, second, event="CH", behind=True)
        self._learn(f, Production("CH"))
        self._text(out, f.name, value)
        f.to_content()

    def _plain(self, out: BitWriter, event: str) -> None:
        ways, second = self._outside() if not self.frames else (self.frames[-1].ways(), [])
        if self.frames:
            second = self._second(self.frames[-1], ways)
        self._code(out, ways, second, event=event)
        if self.frames and event != "NS":
            self.frames[-1].to_content()

    def _write_ns(self, out: BitWriter, name: Name, value: Any) -> None:
        self._plain(out, "NS")
        self.names.write_uri(out, name[0])
        self.names.write_declared(out, name[0], name[1])
        out.nbit(int(value == "true"), 1)

    def _write_cm(self, out: BitWriter, name: Name | None, value: str) -> None:
        self._plain(out, "CM")
        out.string(value)

    def _write_pi(self, out: BitWriter, name: Name, value: str) -> None:
        self._plain(out, "PI")
        out.string(name[1])
        out.string(value)

    def _write_dt(self, out: BitWriter, name: Name, value: str) -> None:
        self._plain(out, "DT")
        for text in (name[1], *value.split("\0")):
            out.string(text)

    def _write_er(self, out: BitWriter, name: Name, value: Any) -> None:
        self._plain(out, "ER")
        out.string(name[1])

    def _write_contained(self, out: BitWriter, events: list[Event], i: int) -> int:
        """The element that has just begun, up to its end, as a part of its own; the place after it."""
        f = self.frames[-1]
        ways = f.ways()
        self._code(out, ways, self._second(f, ways), event="SC")
        j, depth = i, 1
        while depth:
            depth += {"SE": 1, "EE": -1}.get(events[j][0], 0)
            j += 1
        inner = self._part()
        part = BitWriter(self.o.byte_aligned)
        inner.write(part, [("SE", f.name, None), *events[i:j]])
        data = part.done()
        out.align()
        out.unsigned(len(data))
        out.put(int.from_bytes(data, "big"), 8 * len(data))
        self._closed()
        return j

    def _part(self) -> Machine:
        """The same grammars with tables of their own, for a fragment of one element."""
        inner = Machine(self.schema, self.o)
        inner.second = self.second
        inner.begin()
        return inner

    def _limit(self, out: BitWriter, kind: str, name: Name | None, last: str | None) -> None:
        """Under the profile's limits, an element that may not learn becomes of any type, while it can."""
        if not self.schema or not self.frames or kind not in ("SE", "AT", "CH", "EE") or (self.o.max_grammars < 0 and self.o.max_productions < 0):
            return
        f = self.frames[-1]
        if f.type or not f.state or last not in ("SE", "NS"):
            return
        ways = f.ways()
        if (name and self._find(ways, kind, name) is not None) or (not name and any(p.event == kind for p in ways)):
            return
        if not f.learned.may or 0 <= self.o.max_productions <= self.learned:
            self._write_at(out, (*TYPE, "xsi"), clark((XSD_NS, "anyType")))

    # reading

    def decode(self, data: bytes, skip: bool = False) -> list[Event]:
        """Events of a document; skip: without the content of self-contained elements."""
        source, o = read_header(data, self.o)
        codec = Machine(self.schema, o)
        codec.begin()
        return codec.read(source, skip)

    def read(self, source: BitReader, skip: bool = False) -> list[Event]:
        events: list[Event] = []
        while True:
            inside = bool(self.frames)
            f = self.frames[-1] if inside else None
            ways, second = (f.ways(), []) if inside else self._outside()
            if inside:
                second = self._second(f, ways)
            k = source.nbit(width(len(ways) + bool(second)))
            if k < len(ways):
                p, event = ways[k], ways[k].event.partition("-")[0]
            elif k == len(ways) and second:
                p, i = None, source.nbit(width(len(second)))
                if i >= len(second):
                    raise Invalid(f"no event {k}.{i}")
                event = second[i]
                if event == "CM/PI":
                    event = self.third[source.nbit(width(len(self.third)))]
            else:
                raise Invalid(f"no event {k} of {len(ways)}")
            if event == "ED":
                return events
            if event == "SC":
                events += self._read_contained(source, skip)
                continue
            events.append(getattr(self, f"_read_{READ.get(event, event.lower())}")(source, f, ways, p, events))

    def _read_name(self, source: BitReader, p: Production | None) -> Name:
        if p is None or p.event.endswith("-ANY"):
            name = self.names.read(source)
        else:
            name = (p.name[0], self.names.read_local(source, p.name[0])) if p.event.endswith("-NS") else p.name
        return (*name, self.names.read_prefix(source, name[0])) if self.o.prefixes else name

    def _read_se(self, source: BitReader, f: Frame | None, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        name = self._read_name(source, p)
        self._after_se(p, name[:2])
        return "SE", name, None

    def _read_ee(self, source: BitReader, f: Frame, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        if p is None:
            self._learn(f, Production("EE"))
        self._closed()
        return "EE", None, None

    def _read_at(self, source: BitReader, f: Frame, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        name = self._read_name(source, p)
        if p is None:
            self._learn(f, Production("AT", name[:2]))
        if name[:2] == TYPE:
            return self._type_event(source, f, name)
        if name[:2] == NIL and f.type:
            return self._nil_event(source, f, name)
        kind, meta = (p.kind, p.meta or {}) if p and p.kind else self.schema.attributes.get(name[:2], (STRING, {})) if self.schema and f.type else (STRING, {})
        value = self._read_value(source, name, kind, meta)
        if p is not None and f.type:
            f.state = p.next
        return "AT", name, value

    def _read_bad(self, source: BitReader, f: Frame, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        declared = [q for q in ways if q.event == "AT"]
        k = source.nbit(width(len(declared) + 1))
        if k > len(declared):
            raise Invalid("no such attribute")
        name = self._read_name(source, declared[k] if k < len(declared) else None)
        value = self.strings.read(source, clark(name))
        if k < len(declared):
            f.state = declared[k].next
        return "AT", name, value

    def _read_value(self, source: BitReader, name: Name, kind: T.DataType, meta: dict) -> str:
        if self.o.lexical:
            return self.strings.read(source, clark(name), _charset(kind))
        value = read_value(source, self.strings, clark(name), kind, meta)
        return value_text(kind, meta, value)

    def _read_xsi_type(self, source: BitReader, f: Frame, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        return self._type_event(source, f, (*TYPE, self.names.read_prefix(source, XSI_NS)) if self.o.prefixes else TYPE)

    def _type_event(self, source: BitReader, f: Frame, name: Name) -> Event:
        if self.o.lexical:
            text = self.strings.read(source, clark(TYPE))
            prefix, _, local = text.rpartition(":")
            uri = next((fr.scope[prefix] for fr in reversed(self.frames) if prefix in fr.scope), "")
            kind = (uri, local) if uri else from_clark(text)
        else:
            kind = self.names.read(source)
            if self.o.prefixes:
                self.names.read_prefix(source, kind[0])
        if t := self._type_of(kind):
            f.switch(t)
        return "AT", name, clark(kind)

    def _read_xsi_nil(self, source: BitReader, f: Frame, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        return self._nil_event(source, f, (*NIL, self.names.read_prefix(source, XSI_NS)) if self.o.prefixes else NIL)

    def _nil_event(self, source: BitReader, f: Frame, name: Name) -> Event:
        value = self._read_value(source, NIL, T.BooleanType(), {})
        if value.strip() in ("true", "1"):
            f.switch(self.schema.types[f.type.empty])
        return "AT", name, value

    def _read_ch(self, source: BitReader, f: Frame, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        if p is not None and f.type and p.event == "CH":
            value = self._read_value(source, f.name, p.kind, p.meta or {})
        else:
            value = self.strings.read(source, clark(f.name))
        if p is None:
            self._learn(f, Production("CH"))
        if p is not None and f.type:
            f.state = p.next
        else:
            f.to_content()
        return "CH", None, value

    def _read_ns(self, source: BitReader, f: Frame, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        uri = self.names.read_uri(source)
        prefix = self.names.read_declared(source, uri)
        own = bool(source.nbit(1))
        f.scope[prefix] = uri
        if own:  # the element that has just begun has this prefix
            at = next(i for i in range(len(events) - 1, -1, -1) if events[i][0] == "SE")
            events[at] = ("SE", (*events[at][1][:2], prefix), None)
        return "NS", (uri, prefix), str(own).lower()

    def _moved(self, f: Frame | None) -> None:
        if f is not None:
            f.to_content()

    def _read_cm(self, source: BitReader, f: Frame | None, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        self._moved(f)
        return "CM", None, source.string()

    def _read_pi(self, source: BitReader, f: Frame | None, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        self._moved(f)
        return "PI", ("", source.string()), source.string()

    def _read_dt(self, source: BitReader, f: Frame | None, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        name = source.string()
        return "DT", ("", name), "\0".join(source.string() for _ in range(3))

    def _read_er(self, source: BitReader, f: Frame | None, ways: list[Production], p: Production | None, events: list[Event]) -> Event:
        self._moved(f)
        return "ER", ("", source.string()), None

    def _read_contained(self, source: BitReader, skip: bool) -> list[Event]:
        source.align()
        size = source.unsigned()
        events: list[Event] = [("SC", None, None)]
        if skip:
            events.append(("EE", None, None))
        else:
            inner, at = self._part(), source.at // 8
            events += inner.read(BitReader(source.data[at : at + size], 0, source.byte_aligned), skip)[1:]
        source.skip(size)
        self._closed()
        return events


#: Readers' names of events that aren't their own.
READ = {"AT-BAD": "bad", "xsi:type": "xsi_type", "xsi:nil": "xsi_nil"}


def value_text(kind: T.DataType, meta: dict, value: Any) -> str:
    """The text of a typed value, of a list its items' by spaces."""
    if isinstance(kind, T.ArrayType):
        return " ".join(value_text(kind.elementType, meta, x) for x in value)
    if meta.get("base64"):
        import base64

        return base64.b64encode(bytes(value)).decode()
    return value if isinstance(value, str) else text_of(kind, value)


class Contained(Machine):
    """Passes over self-contained elements and notes where their bytes lie: (place, size) in `found`."""

    def begin(self) -> None:
        super().begin()
        self.found: list[tuple[int, int]] = []

    def _read_contained(self, source: BitReader, skip: bool) -> list[Event]:
        source.align()
        size = source.unsigned()
        self.found.append((source.at // 8, size))
        source.skip(size)
        self._closed()
        return [("SC", None, None), ("EE", None, None)]


class SchemaLess(Machine):
    """Documents without a schema: every value a string, grammars learned as the document goes."""

    def __init__(self, o: Options | None = None):
        super().__init__(None, o)


def sane(o: Options) -> None:
    """Refuses options that contradict each other."""
    if o.strict and (o.comments or o.pis or o.dtd or o.prefixes or o.self_contained):
        raise Invalid("strict documents keep no comments, instructions, document types, prefixes or self-contained elements")
    if o.canonical and o.cookie:
        raise Invalid("a canonical document has no cookie")


def _flags(*pairs: tuple[str, Any]) -> list[Event]:
    """Elements of the options document, with their text, for those that are on."""
    out: list[Event] = []
    for name, value in pairs:
        if value is None or value is False:
            continue
        inner = value if isinstance(value, list) else [("CH", None, str(value))] if value is not True else []
        out += [("SE", (EXI_NS, name), None), *inner, ("EE", None, None)]
    return out


def options_events(o: Options) -> list[Event]:
    """The options document: only what differs from the defaults, in its fixed order."""
    some = lambda events: events or None
    limit = lambda n: None if n < 0 else n
    empty = lambda name: [("SE", from_clark(name), None), ("EE", None, None)]
    uncommon = _flags(("alignment", some(_flags(("byte", o.byte_aligned)))), ("selfContained", o.self_contained), ("valueMaxLength", limit(o.max_length)), ("valuePartitionCapacity", limit(o.capacity)))
    for a, b in sorted(o.representations, key=lambda p: tuple(map(from_clark, p))) if o.canonical else o.representations:
        uncommon += _flags(("datatypeRepresentationMap", [*empty(a), *empty(b)]))
    profile = []
    if o.max_grammars >= 0 or o.max_productions >= 0 or not o.local:
        text = f"{'' if o.local else '-'}{o.max_grammars + 1}.{str(o.max_productions + 1)[::-1] if o.max_productions >= 0 else '0'}"
        profile = [("SE", (EXI_NS, "p"), None), ("AT", TYPE, clark((XSD_NS, "decimal"))), ("CH", None, text), ("EE", None, None)]
    preserve = _flags(("dtd", o.dtd), ("prefixes", o.prefixes), ("lexicalValues", o.lexical), ("comments", o.comments), ("pis", o.pis))
    less = _flags(("uncommon", some(profile + uncommon)), ("preserve", some(preserve)))
    schema_id = None if o.schema_id is None else [("AT", NIL, "true")] if o.schema_id == NO_SCHEMA else [("CH", None, o.schema_id)]
    common = _flags(("fragment", o.fragment), ("schemaId", schema_id))
    return _flags(("header", _flags(("lesscommon", some(less)), ("common", some(common)), ("strict", o.strict))))


def write_header(out: BitWriter, o: Options) -> None:
    """Cookie, distinguishing bits, presence of options, version 1, options."""
    if o.cookie:
        for b in COOKIE:
            out.put(b, 8)
    aligned, out.byte_aligned = out.byte_aligned, False
    out.nbit(0b10, 2)
    out.nbit(int(o.with_options or o.canonical), 1)
    out.nbit(0, 5)
    if o.with_options or o.canonical:
        m = Machine(OPTIONS, Options(strict=True))
        m.begin()
        m.write(out, options_events(o))
    out.byte_aligned = aligned
    if aligned:
        out.align()


def read_header(data: bytes, o: Options) -> tuple[BitReader, Options]:
    """A reader at the body, and the options: those given, or those of the header."""
    if o.body_only:
        return BitReader(data, 0, o.byte_aligned), o
    cookie = data.startswith(COOKIE)
    if not cookie and data[:1] == COOKIE[:1]:
        raise Invalid("a wrong cookie")
    source = BitReader(data, 32 if cookie else 0)
    if source.bits(2) != 0b10:
        raise Invalid("no distinguishing bits")
    present = source.bits(1)
    if source.bits(1):
        raise Invalid("a preview version")
    version = 0
    while (part := source.bits(4)) == 15:
        version += part
    if version + part:
        raise Invalid(f"version {version + part + 1}")
    if present:
        m = Machine(OPTIONS, Options(strict=True))
        m.begin()
        o = _options_of(m.read(source), o, cookie)
    source.byte_aligned = o.byte_aligned
    if o.byte_aligned:
        source.align()
    return source, o


def _options_of(events: list[Event], given: Options, cookie: bool) -> Options:
    """Options from the options document; what it can't hold stays as given."""
    from dataclasses import replace

    path, on, text, pairs = [], set(), {}, []
    for i, (kind, name, value) in enumerate(events):
        if kind == "SE":
            path.append(name)
            on.add(name[1] if name[0] == EXI_NS else clark(name))
            if name == (EXI_NS, "datatypeRepresentationMap"):
                pairs.append((clark(events[i + 1][1]), clark(events[i + 3][1])))
        elif kind == "EE":
            path.pop()
        elif kind == "CH":
            text[path[-1][1]] = value
        elif kind == "AT" and name == NIL:
            text["schemaId"] = NO_SCHEMA
    if on & {"compression", "pre-compress"}:
        raise Invalid("compression isn't supported")
    limit = lambda k: int(text[k]) if k in text else -1
    o = Options(
        strict="strict" in on, fragment="fragment" in on, byte_aligned="byte" in on, comments="comments" in on, pis="pis" in on, dtd="dtd" in on, self_contained="selfContained" in on, prefixes="prefixes" in on, lexical="lexicalValues" in on,
        max_length=limit("valueMaxLength"), capacity=limit("valuePartitionCapacity"), schema_id=text.get("schemaId"), representations=tuple(pairs), cookie=cookie, with_options=True,
    )
    o = replace(o, max_productions=given.max_productions, max_grammars=given.max_grammars, local=given.local, shared=given.shared, keep_nil=given.keep_nil, utc=given.utc, canonical=given.canonical)
    if "p" in text:
        whole, _, part = text["p"].lstrip("-").partition(".")
        o = replace(o, local=not text["p"].startswith("-"), max_grammars=int(whole) - 1, max_productions=int((part.rstrip("0") or "0")[::-1]) - 1)
    return o

