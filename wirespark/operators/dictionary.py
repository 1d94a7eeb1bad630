"""Dictionaries that grow along a document, as windows over each document.

A value, URI or local name is spelled at its first occurrence and numbered by it; later occurrences are hits. Values have
two numbers: in the document, and in the context (qualified name) in which they came first. The bounded table, whose
evictions feed back, is a fold over each document's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespark.functions.bits import nbit, unsigned, width
from wirespark.functions.values import characters, charset_characters, string


def value_table(values: DataFrame) -> DataFrame:
    """(doc_id, seq, ctx, value) with hit (miss, local, global), global_id, local_id, and the sizes global_size, local_size before the value. Empty values are never stored."""
    doc, same = Window.partitionBy("doc_id").orderBy("seq"), Window.partitionBy("doc_id", "value").orderBy("seq")
    before = lambda w: F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    first = values.withColumns({"_n": F.row_number().over(same), "_ctx": F.first("ctx").over(same)})
    first = first.withColumn("_new", ((F.col("_n") == 1) & (F.col("value") != "")).cast("int"))
    sized = first.withColumns({"global_size": before(doc), "local_size": before(Window.partitionBy("doc_id", "ctx").orderBy("seq"))})
    hit = F.when((F.col("_n") == 1) | (F.col("value") == ""), "miss").when(F.col("_ctx").eqNullSafe(F.col("ctx")), "local").otherwise("global")
    return sized.withColumns({"hit": hit, "global_id": F.first("global_size").over(same), "local_id": F.first("local_size").over(same)}).drop("_n", "_ctx", "_new")


def seeded(values: DataFrame, shared: list[str]) -> DataFrame:
    """values preceded by shared strings, without context, in every document."""
    docs = values.select("doc_id").distinct()
    seeds = docs.select("doc_id", F.posexplode(F.array(*map(F.lit, shared))).alias("p", "value")).select("doc_id", (F.col("p") - len(shared)).cast("long").alias("seq"), F.lit(None).cast("string").alias("ctx"), "value")
    return values.unionByName(seeds)


def _hit_bits(miss: Column) -> Column:
    local = F.concat(unsigned(F.lit(0)), nbit(F.col("local_id"), width(F.col("local_size"))))
    other = F.concat(unsigned(F.lit(1)), nbit(F.col("global_id"), width(F.col("global_size"))))
    return F.when(F.col("hit") == "local", local).when(F.col("hit") == "global", other).otherwise(miss)


def value_bits(charset: str | None = None) -> Column:
    """Bits of a row of value_table; charset: a restricted set that spells what the table lacks."""
    spelled = characters(F.col("value")) if charset is None else charset_characters(F.col("value"), charset)
    return _hit_bits(F.concat(unsigned(F.char_length("value") + 2), spelled))


def extended_table(values: DataFrame, members: list[str]) -> DataFrame:
    """value_table() with likely values (members) that are told by their place and never stored: hit `member` and local_id, the place; and bits. 3 to 5 are reserved, so other strings' lengths start at 6."""
    place = F.array_position(F.array(*map(F.lit, members)), F.col("value")) - 1
    marked = values.withColumn("_place", place)
    none = F.lit(None).cast("long")
    own = marked.where("_place >= 0").select("doc_id", "seq", "ctx", "value", F.lit("member").alias("hit"), none.alias("global_size"), none.alias("local_size"), none.alias("global_id"), F.col("_place").cast("long").alias("local_id"))
    rest = value_table(marked.where("_place < 0 or value is null").drop("_place")).select(*own.columns)
    member = F.concat(unsigned(F.lit(2)), nbit(F.col("local_id"), (len(members) - 1).bit_length()))
    literal = F.concat(unsigned(F.char_length("value") + 6), characters(F.col("value")))
    return own.unionByName(rest).withColumn("bits", F.when(F.col("hit") == "member", member).otherwise(_hit_bits(literal)))


def name_table(names: DataFrame, keys: list[str], name: str, given: list[str] = ()) -> DataFrame:
    """names (keys, seq, name) with known, id and size, the number of names before; given: names that every table starts with."""
    by, same = Window.partitionBy(*keys).orderBy("seq"), Window.partitionBy(*keys, name).orderBy("seq")
    start = F.array_position(F.array(*map(F.lit, given)), F.col(name)) - 1 if given else F.lit(-1)
    marked = names.withColumn("_given", start.cast("long")).withColumn("_new", ((F.row_number().over(same) == 1) & (F.col("_given") < 0)).cast("int"))
    size = F.coalesce(F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long") + len(given)
    sized = marked.withColumn("size", size)
    return sized.withColumn("id", F.when(F.col("_given") >= 0, F.col("_given")).otherwise(F.first("size").over(same))).withColumn("known", F.col("_new") == 0).drop("_given", "_new")


def local_name_bits(name: str) -> Column:
    hit = F.concat(unsigned(F.lit(0)), nbit(F.col("id"), width(F.col("size"))))
    return F.when(F.col("known"), hit).otherwise(F.concat(unsigned(F.char_length(name) + 1), characters(F.col(name))))


def uri_bits(uri: str) -> Column:
    w = width(F.col("size") + 1)
    return F.when(F.col("known"), nbit(F.col("id") + 1, w)).otherwise(F.concat(nbit(F.lit(0), w), string(F.col(uri))))


def qname_table(names: DataFrame, given: list[str]) -> DataFrame:
    """names (doc_id, seq, uri, name) with the bits of a qualified name: its URI's, then its local name's in the table of that URI."""
    uris = name_table(names, ["doc_id"], "uri", given).withColumn("uri_bits", uri_bits("uri")).drop("known", "id", "size")
    return name_table(uris, ["doc_id", "uri"], "name").select("doc_id", "seq", "uri", "name", F.concat("uri_bits", local_name_bits("name")).alias("bits"))


def prefix_table(declared: DataFrame) -> DataFrame:
    """declared (doc_id, seq, uri, prefix) with known, id and size in the URI's prefixes, the bits of the declaration, and those of a name that uses the prefix right after it: none if the URI has no other."""
    by = ["doc_id", "uri"]
    rows = name_table(declared, by, "prefix")
    w = width(F.col("size") + 1)
    after = F.col("size") + (~F.col("known")).cast("int")
    bits = F.when(F.col("known"), nbit(F.col("id") + 1, w)).otherwise(F.concat(nbit(F.lit(0), w), string(F.col("prefix"))))
    return rows.withColumn("bits", bits).withColumn("use_bits", nbit(F.col("id"), width(after)))


class BoundedTable:
    """Values of at most max_length characters, capacity of them at a time: a ring whose new entry takes the oldest one's number and its local number's place."""

    def __init__(self, capacity: int = -1, max_length: int = -1, local: bool = True):
        self.capacity, self.max_length, self.local = capacity, max_length, local
        self.values: list[tuple[str, str, int] | None] = []
        self.where: dict[str, int] = {}
        self.parts: dict[str, list[str | None]] = {}
        self.next = 0

    def find(self, ctx: str, value: str) -> tuple[str, int, int]:
        """(hit, number, size of its table)."""
        at = self.where.get(value)
        if at is None:
            return "miss", -1, 0
        _, own, local = self.values[at]
        if self.local and own == ctx:
            return "local", local, len(self.parts[ctx])
        return "global", at, len(self.values)

    def add(self, ctx: str, value: str) -> None:
        if not value or 0 <= self.max_length < len(value) or self.capacity == 0 or value in self.where:
            return
        part = self.parts.setdefault(ctx, [])
        entry = (value, ctx, len(part))
        part.append(value)
        if self.capacity < 0 or len(self.values) < self.capacity:
            self.where[value] = len(self.values)
            self.values.append(entry)
        else:
            old, own, local = self.values[self.next]
            del self.where[old]
            self.parts[own][local] = None
            self.values[self.next], self.where[value] = entry, self.next
        if self.capacity > 0:
            self.next = (self.next + 1) % self.capacity


def bounded_table(values: DataFrame, capacity: int = -1, max_length: int = -1, local: bool = True) -> DataFrame:
    """(doc_id, seq, ctx, value, hit, id, size) with a bounded table for each document; documents are folded one after the other in sorted partitions."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, table = None, None
        for batch in batches:
            out = []
            for d, ctx, value in zip(batch.column("doc_id").to_pylist(), batch.column("ctx").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if table is None or d != doc:
                    doc, table = d, BoundedTable(capacity, max_length, local)
                found = table.find(ctx, value)
                if found[0] == "miss":
                    table.add(ctx, value)
                out.append(found)
            hit, number, size = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.string()), pa.array(number, pa.int64()), pa.array(size, pa.int64())], [*batch.schema.names, "hit", "id", "size"])

    rows = values.select("doc_id", "seq", "ctx", "value").repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return rows.mapInArrow(fold, "doc_id long, seq long, ctx string, value string, hit string, id long, size long")


def learned_codes(children: DataFrame) -> DataFrame:
    """(doc_id, seq, name) with known, code and width of the start event in a learning content grammar: the newest production has code 0, unknown names the escape code."""
    same, by = Window.partitionBy("doc_id", "name").orderBy("seq"), Window.partitionBy("doc_id").orderBy("seq")
    # the first child is learned by the start-tag grammar; the content grammar starts with the end of the element
    later = children.withColumn("_first", F.row_number().over(by)).where("_first > 1")
    new = later.withColumn("_new", (F.row_number().over(same) == 1).cast("int"))
    n = F.coalesce(F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long") + 1
    sized = new.withColumn("n", n)
    code = F.when(F.col("_new") == 1, F.col("n")).otherwise(F.col("n") - 1 - F.first("n").over(same))
    return sized.select("doc_id", "seq", "name", (F.col("_new") == 0).alias("known"), code.cast("long").alias("code"), width(F.col("n") + 1).cast("long").alias("width"))
