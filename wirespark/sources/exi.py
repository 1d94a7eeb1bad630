"""Compact binary XML documents as DataFrames: rows, events and XML text to bytes and back, files, a data source.

A document is a row (content BINARY); documents are coded one by one in Arrow batches, so they are the unit of
parallelism and of recovery. Bad documents fail the task, or give null with mode "permissive".
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from wirespark.sources.codec import COOKIE, XML_NS, XSI_NS, Event, Invalid, Machine, Options, Schema, read_header
from wirespark.sources.machine import NIL, TYPE, Contained, from_clark
from wirespark.sources.rows import ByRoot, Rows, codec

EVENTS = "array<struct<event:string,ns:string,local:string,value:string,prefix:string>>"


#: White space that XML attributes keep only as references.
REFERENCES = {"\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}


def header(content: Column) -> Column:
    """(cookie, options, version, valid) of a document's first bytes, as an expression; version 0 is the first one."""
    from wirespark.functions.bits import read, unpack

    bits = unpack(F.substring(content, 1, 6))
    cookie = F.substring(content, 1, 4) == F.lit(b"$EXI")
    at = F.when(cookie, 32).otherwise(0)
    one = lambda k, n: read(bits, at + k, n)
    wrong = (F.substring(content, 1, 1) == F.lit(b"$")) & ~cookie
    valid = ~wrong & (one(0, 2) == 2) & (one(3, 1) == 0) & (one(4, 4) == 0)
    return F.struct(cookie.alias("cookie"), (one(2, 1) == 1).alias("options"), one(4, 4).alias("version"), valid.alias("valid"))


def _mapped(df: DataFrame, column: str, made: str, kind: T.DataType | str, each: Callable, mode: str = "failfast", reason: str | None = None) -> DataFrame:
    """df with column `column` replaced by `made`, each value by each(value); null stays null. mode permissive: bad values give null, and `reason` names a column for why."""
    others = [c for c in df.columns if c != column]
    kind = T.StructType.fromDDL(f"x {kind}")[0].dataType if isinstance(kind, str) else kind
    extra = [reason] if reason else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        to = to_arrow_type(kind)
        for batch in batches:
            out, why = [], []
            for x in batch.column(column).to_pylist():
                try:
                    out.append(None if x is None else each(x))
                    why.append(None)
                except (ValueError, IndexError, KeyError, TypeError, AttributeError, OverflowError, StopIteration) as e:
                    if mode == "failfast":
                        raise Invalid(str(e)) from e
                    out.append(None)
                    why.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(out, to), *[pa.array(why, pa.string())] * len(extra)], [*others, made, *extra])

    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(made, kind), *(T.StructField(c, T.StringType()) for c in extra)])
    return df.mapInArrow(run, schema)


def relaxed(kind: T.DataType) -> T.DataType:
    """A type in which every field and item may be null, as nil and absent ones are."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType), True, f.metadata) for f in kind])
    return T.ArrayType(relaxed(kind.elementType), True) if isinstance(kind, T.ArrayType) else kind


def encode_rows(df: DataFrame, root: str, options: Options | None = None, schema: T.StructType | None = None, meta: dict | None = None, informed: bool = True) -> DataFrame:
    """(content): each row a document of df's schema, or of one with metadata (see schema.py); informed False: without a schema, all values as text."""
    o = options or Options(strict=True)
    made = codec(schema or df.schema, root, o, meta, informed)
    return _mapped(df.select(F.struct(*df.columns).alias("row")), "row", "content", T.BinaryType(), lambda row: made.encode(row, o))


def decode_rows(df: DataFrame, root: str, schema: T.StructType, options: Options | None = None, mode: str = "failfast", meta: dict | None = None, informed: bool = True, reason: str | None = None) -> DataFrame:
    """The rows of documents (content); other columns stay beside them as they are."""
    o = options or Options(strict=True)
    made = codec(schema, root, o, meta, informed)
    others = [c for c in df.columns if c != "content"]
    return _mapped(df, "content", "row", relaxed(schema), lambda x: made.decode(bytes(x), o), mode, reason).select(*others, "row.*", *([reason] if reason else []))


def decode_by_root(df: DataFrame, schemas: dict[str, T.StructType], options: Options | None = None, mode: str = "failfast") -> DataFrame:
    """Documents of several kinds: the root's name and a struct for each kind, all null but its own; other columns stay beside."""
    made, o = ByRoot(schemas), options or Options(strict=True)
    kind = T.StructType([T.StructField("root", T.StringType()), *(T.StructField(n, relaxed(s)) for n, s in schemas.items())])

    def each(x: bytes) -> dict:
        root, row = made.decode(bytes(x), o)
        return {"root": root, root: row}

    others = [c for c in df.columns if c != "content"]
    return _mapped(df, "content", "row", kind, each, mode).select(*others, "row.*")


def by_schema_id(df: DataFrame, schemas: dict[str, tuple[str, T.StructType]], mode: str = "failfast") -> DataFrame:
    """Documents (content) whose headers name a schema: (schema_id, one struct for each id's schema). schemas: {id: (root, schema)}; an unknown id is an error."""
    made = {k: (root, s) for k, (root, s) in schemas.items()}
    kind = T.StructType([T.StructField("schema_id", T.StringType()), *(T.StructField(k, relaxed(s)) for k, (_, s) in made.items())])

    def each(x: bytes) -> dict:
        _, o = read_header(bytes(x), Options())
        if o.schema_id not in made:
            raise Invalid(f"no schema {o.schema_id}")
        root, s = made[o.schema_id]
        return {"schema_id": o.schema_id, o.schema_id: Rows(s, root).decode(bytes(x), Options())}

    others = [c for c in df.columns if c != "content"]
    return _mapped(df, "content", "row", kind, each, mode).select(*others, "row.*")


def headers(df: DataFrame, mode: str = "failfast") -> DataFrame:
    """The options that documents' headers (content) hold, in a column `header`; other columns stay beside."""
    kind = "struct<cookie:boolean,with_options:boolean,strict:boolean,fragment:boolean,byte_aligned:boolean,comments:boolean,pis:boolean,dtd:boolean,prefixes:boolean,lexical:boolean,self_contained:boolean,max_length:bigint,capacity:bigint,schema_id:string>"

    names = re.findall(r"(\w+):", kind)

    def each(x: bytes) -> dict:
        _, o = read_header(bytes(x), Options())
        return {k: getattr(o, k) for k in names} | {"cookie": bytes(x).startswith(COOKIE)}

    return _mapped(df, "content", "header", kind, each, mode)


def encode_events(df: DataFrame, column: str = "events", options: Options | None = None, schema: Schema | None = None) -> DataFrame:
    """Documents from arrays of events, with a schema's grammars or without."""
    o = options or Options()
    return _mapped(df, column, "content", T.BinaryType(), lambda es: Machine(schema, o).encode([_event(e) for e in es]))


def decode_events(df: DataFrame, options: Options | None = None, mode: str = "failfast", schema: Schema | None = None, skip: bool = False) -> DataFrame:
    """Arrays of events from documents (content); skip: without the content of self-contained elements, which is passed over."""
    o = options or Options()
    return _mapped(df, "content", "events", EVENTS, lambda x: [_struct(e) for e in Machine(schema, o).decode(bytes(x), skip)], mode)


def contained(df: DataFrame, options: Options, key: str) -> DataFrame:
    """(key, part, at, size): where the self-contained elements outside others lie in documents (content), in bytes, as a reader passes over them."""

    def each(x: bytes) -> list[dict]:
        source, o = read_header(bytes(x), options)
        machine = Contained(None, o)
        machine.begin()
        machine.read(source, True)
        return [{"at": a, "size": n} for a, n in machine.found]

    rows = _mapped(df.select(key, "content"), "content", "parts", "array<struct<at:bigint,size:bigint>>", each)
    return rows.select(key, F.posexplode("parts").alias("part", "p")).select(key, F.col("part").cast("long").alias("part"), "p.at", "p.size")


def event_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, seq, event, ns, local, value, prefix) from arrays of events."""
    return df.select(key, F.posexplode("events").alias("seq", "e")).select(key, "seq", "e.*")


def _event(e: dict) -> Event:
    if e["local"] is None:
        return e["event"], None, e["value"]
    name = (e["ns"] or "", e["local"])
    return e["event"], name if e.get("prefix") is None else (*name, e["prefix"]), e["value"]


def _struct(e: Event) -> dict:
    kind, name, value = e
    return {"event": kind, "ns": name and name[0], "local": name and name[1], "value": value, "prefix": name[2] if name and len(name) > 2 else None}


def parse_xml(text: str, options: Options | None = None) -> list[Event]:
    """Events of XML text: adjacent text merged, white space alone dropped beside elements unless xml:space says otherwise, attributes sorted by local name and namespace behind xsi:type and xsi:nil. schemaLocation is dropped. With their option: namespaces and prefixes, comments, instructions, document type and references to entities."""
    o, events, held = options or Options(), [], []
    opened, keep, scopes, declared = [False], [False], [{}], []  # has the element around had child elements?

    def flush(before_child: bool) -> None:
        value = "".join(held)
        held.clear()
        if value and len(opened) > 1 and (keep[-1] or value.strip(" \t\r\n") or not (before_child or opened[-1])):
            events.append(("CH", None, value))

    def name(x: str) -> tuple:
        uri, local, prefix = (x.split(" ") + [""])[:3] if " " in x else ("", x, "")
        return (uri, local, prefix) if o.prefixes else (uri, local)

    def type_name(value: str) -> str:
        prefix, _, local = value.strip().rpartition(":")
        uri = scopes[-1].get(prefix, "")
        return f"{{{uri}}}{local}" if uri or not prefix else value

    def start(found: str, attributes: list[str]) -> None:
        flush(True)
        opened[-1] = True
        opened.append(False)
        own = name(found)
        events.append(("SE", own, None))
        scopes.append({**scopes[-1], **dict(declared)})
        if o.prefixes:
            events.extend(("NS", (uri, p), str(p == own[2]).lower()) for p, uri in (sorted(declared) if o.canonical else declared))
        declared.clear()
        pairs = [(name(k), v) for k, v in zip(attributes[::2], attributes[1::2], strict=True)]
        pairs = [(k, type_name(v) if k[:2] == TYPE else v) for k, v in pairs if k[:2] not in ((XSI_NS, "schemaLocation"), (XSI_NS, "noNamespaceSchemaLocation"))]
        rank = lambda k: (TYPE, NIL).index(k[:2]) if k[:2] in (TYPE, NIL) else 2
        events.extend(("AT", k, v) for k, v in sorted(pairs, key=lambda p: (rank(p[0]), p[0][1], p[0][0])))
        space = dict((k[:2], v) for k, v in pairs).get((XML_NS, "space"))
        keep.append({"preserve": True, "default": False}.get(space, keep[-1]))

    def end(found: str) -> None:
        flush(False)
        for stack in (opened, keep, scopes):
            stack.pop()
        events.append(("EE", None, None))

    def other(event: Event, on: bool) -> None:
        if on and not inside_type:
            flush(False)
            events.append(event)

    inside_type: list[bool] = []

    def doctype(name: str, system: str | None, public: str | None, internal: int) -> None:
        inside_type.append(True)
        if o.dtd:
            events.append(("DT", ("", name), "\0".join((public or "", system or "", _internal_subset(text) if internal else ""))))

    def unhandled(data: str) -> None:
        if data.startswith("&") and data.endswith(";") and len(opened) > 1:
            other(("ER", ("", data[1:-1]), None), True)

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.ordered_attributes, parser.buffer_text, parser.namespace_prefixes = True, True, True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
    parser.StartNamespaceDeclHandler = lambda prefix, uri: declared.append((prefix or "", uri or ""))
    parser.CommentHandler = lambda s: other(("CM", None, s), o.comments)
    parser.ProcessingInstructionHandler = lambda t, s: other(("PI", ("", t), s), o.pis)
    parser.StartDoctypeDeclHandler, parser.EndDoctypeDeclHandler = doctype, inside_type.clear
    if o.dtd:
        parser.DefaultHandler = unhandled  # with it, entities aren't replaced
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        raise Invalid(str(e)) from e
    return events


def _internal_subset(text: str) -> str:
    """What stands between the brackets of a document type declaration; quotes and comments may hold brackets."""
    at = text.index("[", text.index("<!DOCTYPE"))
    found = re.compile(r"""<!--.*?-->|<\?.*?\?>|"[^"]*"|'[^']*'|\]|[^\]"'<]+|<""", re.S)
    end = at + 1
    while (m := found.match(text, end)) and m.group() != "]":
        end = m.end()
    return text[at + 1 : end]


def format_xml(events: list[Event]) -> str:
    """XML text of events; names without a prefix of their own get ns0, ns1, ..., declared on the root. White space that keeps its meaning only in references is written so."""
    kept = {uri: p for kind, n, _ in events if kind == "NS" for uri, p in [n]}
    typed = {from_clark(v)[0] for kind, n, v in events if kind == "AT" and n[:2] == TYPE}
    spaces = [u for u in dict.fromkeys([n[0] for kind, n, _ in events if kind in ("SE", "AT")] + sorted(typed)) if u not in ("", XML_NS) and u not in kept]
    made = {u: "xsi" if u == XSI_NS else f"ns{i}" for i, u in enumerate(spaces)}
    prefixes = {"": "", XML_NS: "xml"} | made | kept
    out, stack, tag_open = [], [], False

    def written(name: tuple) -> str:
        prefix = name[2] if len(name) > 2 and name[2] is not None and (name[2] or not name[0] or name[0] in kept) else prefixes[name[0]]
        return f"{prefix}:{name[1]}" if prefix else name[1]

    def close() -> None:
        nonlocal tag_open
        if tag_open:
            out.append(">")
            tag_open = False

    for kind, name, value in events:
        if kind == "AT":
            if name[:2] == TYPE:
                value = written(from_clark(value))
            out.append(f" {written(name)}={quoteattr(value, REFERENCES)}")
            continue
        if kind == "NS":
            out.append(f" xmlns{':' if name[1] else ''}{name[1]}={quoteattr(name[0])}")
            continue
        if kind == "SC":
            continue
        if kind == "EE" and tag_open:
            out.append("/>")
            stack.pop()
            tag_open = False
            continue
        close()
        if kind == "SE":
            stack.append(written(name))
            out.append(f"<{stack[-1]}")
            if len(stack) == 1:
                out.extend(f" xmlns:{p}={quoteattr(u)}" for u, p in made.items())
            tag_open = True
        elif kind == "EE":
            out.append(f"</{stack.pop()}>")
        elif kind == "CH":
            out.append(escape(value, {"\r": "&#13;"}))
        elif kind == "CM":
            out.append(f"<!--{value}-->")
        elif kind == "PI":
            out.append(f"<?{name[1]} {value}?>")
        elif kind == "ER":
            out.append(f"&{name[1]};")
        elif kind == "DT":
            public, system, internal = value.split("\0")
            where = f' PUBLIC "{public}" "{system}"' if public else f' SYSTEM "{system}"' if system else ""
            out.append(f"<!DOCTYPE {name[1]}{where}{f' [{internal}]' if internal else ''}>")
    return "".join(out)


def encode_xml(df: DataFrame, column: str = "xml", options: Options | None = None, mode: str = "failfast", schema: Schema | None = None) -> DataFrame:
    """Documents (content) from XML text, with a schema's grammars or without."""
    o = options or Options()
    return _mapped(df, column, "content", T.BinaryType(), lambda x: Machine(schema, o).encode(parse_xml(x, o)), mode)


def decode_xml(df: DataFrame, options: Options | None = None, mode: str = "failfast", schema: Schema | None = None) -> DataFrame:
    """XML text from documents (content)."""
    o = options or Options()
    return _mapped(df, "content", "xml", T.StringType(), lambda x: format_xml(Machine(schema, o).decode(bytes(x))), mode)


class _Part(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.root, self.schema = options["path"], options.get("root", "row"), schema
        self.options, self.informed = _options(options), options.get("informed", "true").lower() == "true"

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        return [_Part(f) for f in _data_files(store, root, fs)]

    def read(self, part: _Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        made = codec(self.schema, self.root, self.options, None, self.informed)
        with store.open_input_stream(part.value) as f:
            if part.value.endswith(".exi"):
                yield _tuple(made.decode(f.read(), self.options), self.schema)
                return
            while head := f.read(4):
                yield _tuple(made.decode(f.read(int.from_bytes(head, "big")), self.options), self.schema)


def _data_files(store, root: str, fs) -> list[str]:
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return []
    files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
    return sorted(f.path for f in files if f.path.endswith((".exi", ".exis")))


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task, by name, in the write's own folder."""

    files: tuple[str, ...]


class _Writer(DataSourceWriter):
    """Tasks write into a folder of the write's own; commit moves their files into place, abort deletes it. Names hold the write's id, so appends don't meet."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.root, self.schema, self.options, self.overwrite = options["path"], options.get("root", "row"), schema, _options(options), overwrite
        self.single, self.informed, self.id = options.get("layout", "framed").lower() == "single", options.get("informed", "true").lower() == "true", uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        return store, root, f"{root}/_writing-{self.id}"

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, _, own = self._store()
        store.create_dir(own, recursive=True)
        made, files = codec(self.schema, self.root, self.options, None, self.informed), []
        base = f"part-{task.partitionId():06d}-{self.id}-{task.taskAttemptId()}"
        documents = (made.encode(row.asDict(recursive=True), self.options) for row in rows)
        if self.single:
            for i, data in enumerate(documents):
                files.append(f"{base}-{i:09d}.exi")
                with store.open_output_stream(f"{own}/{files[-1]}", compression=None) as f:
                    f.write(data)
        else:
            files.append(f"{base}.exis")
            with store.open_output_stream(f"{own}/{files[-1]}", compression=None) as f:
                for data in documents:
                    f.write(len(data).to_bytes(4, "big") + data)
        return _Written(tuple(files))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root, own = self._store()
        old = _data_files(store, root, fs) if self.overwrite else []
        for m in messages:
            for name in m.files if m else ():
                store.move(f"{own}/{name}", f"{root}/{name}")
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, _, own = self._store()
        if store.get_file_info(own).type != fs.FileType.NotFound:
            store.delete_dir(own)


def _tuple(row: dict, schema: T.StructType) -> tuple:
    def of(v, kind):
        if v is None:
            return None
        if isinstance(kind, T.StructType):
            return _tuple(v, kind)
        return [of(x, kind.elementType) for x in v] if isinstance(kind, T.ArrayType) else v

    return tuple(of(row[f.name], f.dataType) for f in schema)


def _options(given: dict) -> Options:
    """Options from text, by the names of their fields; unknown ones but path, root, layout and informed are refused."""
    known, out = asdict(Options(strict=True)), {}
    names = {k.lower(): k for k in known}
    for k, v in given.items():
        if k.lower() in ("path", "root", "layout", "informed"):
            continue
        if k.lower() not in names:
            raise ValueError(f"unknown option {k}")
        kind = type(known[names[k.lower()]])
        out[names[k.lower()]] = v.lower() == "true" if kind is bool else tuple(v.split(",")) if kind is tuple else int(v) if kind is int else v
    return Options(**{"strict": True, **out})


class ExiSource(DataSource):
    """spark.read.format("exi").schema(...).option("root", ...).load(uri), and writing. A file .exi is one document, as others write it; a file .exis holds many, each behind its length in four bytes. Option layout: framed (.exis, the default) or single (.exi). Options of documents by the names of Options; informed false: without a schema."""

    @classmethod
    def name(cls) -> str:
        return "exi"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExiSource)
