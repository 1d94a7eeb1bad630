"""Queries through whole documents: codecs, headers, XML, names and prefixes, scopes, tables of strings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirespark.functions import values as V
from wirespark.operators import dictionary as D
from wirespark.operators import events as E
from wirespark.operators.representation import represented
from wirespark.plans import oracle as O
from wirespark.plans.queries import names, turns
from wirespark.plans.registry import long, query, table
from wirespark.sources import exi
from wirespark.sources.codec import GIVEN, Options, Schema
from wirespark.sources.machine import NO_SCHEMA

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
CUSTOMER_DDL = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING"


def _xml(*fields: str, root: str = "customer", extra: str = ""):
    """XML text of a row, with more before its fields."""
    own = [x for f in fields for x in (F.lit(f"<{f}>"), F.col(f).cast("string"), F.lit(f"</{f}>"))]
    return F.concat(F.lit(f"<{root}>{extra}"), *own, F.lit(f"</{root}>"))


@query(f"SELECT {', '.join(CUSTOMER)} FROM customer")
def xml_roundtrip(spark, d):
    """Rows to XML text, to documents without a schema, and all the way back."""
    xml = table(spark, d, "customer").select(_xml(*CUSTOMER).alias("xml"))
    back = exi.decode_xml(exi.encode_xml(xml))
    return back.select(F.from_xml("xml", CUSTOMER_DDL, {"rowTag": "customer"}).alias("r")).select("r.*")


@query(f"SELECT {', '.join(CUSTOMER)} FROM customer")
def xml_to_rows(spark, d):
    """XML text to typed documents of a schema that isn't strict, with an element and an attribute that it lacks, to rows."""
    schema = T.StructType.fromDDL(CUSTOMER_DDL)
    xml = table(spark, d, "customer").select(_xml(*CUSTOMER, extra="<note lang='en'>not <b>declared</b></note>").alias("xml"))
    docs = exi.encode_xml(xml, options=Options(), schema=Schema.of(schema, "customer"))
    return exi.decode_rows(docs, "customer", schema, Options())


@query(f"SELECT CAST(r_regionkey AS BIGINT) AS key, {O.packed('b')} AS hex FROM (SELECT r_regionkey, '10000000' || '0' || '00' || {O.sint('r_regionkey')} || '0' || {O.text('r_name', 2)} AS b FROM region)")
def encode_hex(spark, d):
    """The bytes of strict documents: header, root, then each optional field's code and value."""
    region = table(spark, d, "region").select(long("r_regionkey").alias("key"), "r_name")
    docs = exi.encode_rows(region, "region")
    return exi.decode_rows(docs.withColumn("hex", F.hex("content")), "region", region.schema).select("key", "hex")


OPTION_SETS = {
    "plain": Options(), "cookie": Options(cookie=True), "strict": Options(strict=True, with_options=True), "fragment": Options(fragment=True, with_options=True), "byte": Options(byte_aligned=True, with_options=True, cookie=True),
    "kept": Options(comments=True, pis=True, dtd=True, prefixes=True, with_options=True), "lexical": Options(lexical=True, prefixes=True, with_options=True), "limits": Options(max_length=9, capacity=300, self_contained=True, with_options=True), "schema": Options(schema_id="urn:s", with_options=True),
    "none": Options(schema_id=NO_SCHEMA, with_options=True),
}
FLAGS = ("cookie", "with_options", "strict", "fragment", "byte_aligned", "comments", "pis", "dtd", "prefixes", "lexical", "self_contained")
SET_FLAGS = {"plain": (), "cookie": ("cookie",), "strict": ("with_options", "strict"), "fragment": ("with_options", "fragment"), "byte": ("cookie", "with_options", "byte_aligned"), "kept": ("with_options", "comments", "pis", "dtd", "prefixes"), "lexical": ("with_options", "lexical", "prefixes"), "limits": ("with_options", "self_contained"), "schema": ("with_options",), "none": ("with_options",)}


@query(" UNION ALL ".join(
    f"SELECT CAST(r_regionkey AS BIGINT) AS key, '{name}' AS name, {', '.join(f'{str(f in on).lower()} AS {f}' for f in FLAGS)}, CAST({9 if name == 'limits' else -1} AS BIGINT) AS max_length, CAST({300 if name == 'limits' else -1} AS BIGINT) AS capacity, CAST({ {'schema': repr('urn:s'), 'none': repr('xsi:nil')}.get(name, 'NULL') } AS VARCHAR) AS schema_id FROM region"
    for name, on in SET_FLAGS.items()
))
def header_options(spark, d):
    """The options that headers of documents hold, read from their bytes."""
    rows, out = table(spark, d, "region").select(long("r_regionkey").alias("r_regionkey"), F.lit("<r>x</r>").alias("xml")), None
    for name, o in OPTION_SETS.items():
        one = exi.headers(exi.encode_xml(rows, options=o)).select(F.col("r_regionkey").alias("key"), F.lit(name).alias("name"), "header.*")
        out = one if out is None else out.unionByName(one)
    return out


def _event(kind: str, local: str | None = None, value=None):
    return F.struct(F.lit(kind).alias("event"), F.lit(None if local is None else "").cast("string").alias("ns"), F.lit(local).cast("string").alias("local"), (F.lit(None) if value is None else value).cast("string").alias("value"), F.lit(None).cast("string").alias("prefix"))


LINES = "SELECT l_orderkey AS key, CAST(l_partkey AS VARCHAR) AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem"


@query(f"""WITH s AS (SELECT key, t, n, CAST(7 + length(t) AS BIGINT) AS size FROM ({LINES}))
SELECT key, CAST(n - 1 AS BIGINT) AS part, size, CAST(15 + coalesce(sum(size + 2) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN n > 1 THEN 1 ELSE 0 END AS BIGINT) AS at FROM s""")
def sc_index(spark, d):
    """Where the self-contained lines of an order's document lie, as a reader that passes over them finds."""
    by = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(by.alias("lines"))
    line = lambda x: F.array(_event("SE", "line"), _event("SC"), _event("CH", None, x["l_partkey"]), _event("EE"))
    events = F.concat(F.array(_event("SE", "order")), F.flatten(F.transform("lines", line)), F.array(_event("EE")))
    o = Options(self_contained=True)
    return exi.contained(exi.encode_events(docs.select("key", events.alias("events")), options=o), o, "key")


@query(f"SELECT key, CAST(n AS BIGINT) AS n, t AS text FROM ({LINES})")
def sc_events(spark, d):
    """The text of all self-contained lines; a reader that skips them finds none."""
    by = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(by.alias("lines"))
    line = lambda x: F.array(_event("SE", "line"), _event("SC"), _event("CH", None, x["l_partkey"]), _event("EE"))
    events = F.concat(F.array(_event("SE", "order")), F.flatten(F.transform("lines", line)), F.array(_event("EE")))
    o = Options(self_contained=True, byte_aligned=True)
    whole = exi.decode_events(exi.encode_events(docs.select("key", events.alias("events")), options=o), o)
    texts = F.filter("events", lambda e: e["event"] == "CH")
    return whole.select("key", F.posexplode(texts).alias("i", "e")).select("key", long(F.col("i") + 1).alias("n"), F.col("e.value").alias("text"))


ORDER_NIL = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderpriority", T.StringType(), False, {"nillable": True}), T.StructField("o_clerk", T.ArrayType(T.StringType()), False, {"nillable": True})])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority, [o_orderstatus, NULL, 'x'] AS o_clerk FROM orders")
def nil_roundtrip(spark, d):
    """Nulls as nil elements, in strict documents and in an array."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), F.array(F.col("o_orderstatus"), F.lit(None).cast("string"), F.lit("x")).alias("o_clerk"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderpriority", T.StringType()), T.StructField("o_clerk", T.ArrayType(T.StringType()))])
    docs = exi.encode_rows(rows, "order", Options(strict=True), ORDER_NIL)
    back = exi.decode_rows(docs, "order", ORDER_NIL, Options(strict=True))
    return back.select(*[F.col(f.name).cast(f.dataType) for f in schema])


SHAPES = {"Small": ["size"], "Large": ["brand"]}


@query("SELECT p_partkey AS key, CASE WHEN p_size < 25 THEN 'Small' ELSE 'Large' END AS type, CASE WHEN p_size < 25 THEN CAST(p_size AS BIGINT) END AS size, CASE WHEN p_size >= 25 THEN p_brand END AS brand FROM part")
def type_roundtrip(spark, d):
    """Elements of named types, told by xsi:type, in documents that aren't strict."""
    shape = T.StructType([T.StructField("_xsi_type", T.StringType()), T.StructField("size", T.LongType()), T.StructField("brand", T.StringType())])
    schema = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("part", shape, False, {"types": SHAPES})])
    small = F.col("p_size") < 25
    part = F.struct(F.when(small, "Small").otherwise("Large").alias("_xsi_type"), F.when(small, long("p_size")).alias("size"), F.when(~small, F.col("p_brand")).alias("brand"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), part.alias("part"))
    back = exi.decode_rows(exi.encode_rows(rows, "p", Options(), schema), "p", schema, Options())
    return back.select("key", F.col("part._xsi_type").alias("type"), "part.size", "part.brand")


@query("""SELECT c_custkey AS key, CAST(unnest(range(0, 9)) AS BIGINT) AS seq, unnest(['SE', 'NS', 'NS', 'AT', 'SE', 'AT', 'CH', 'EE', 'EE']) AS event, unnest(['urn:c', 'urn:c', 'urn:' || (c_custkey % 3), '', 'urn:' || (c_custkey % 3), 'urn:c', NULL, NULL, NULL]) AS ns,
unnest(['customer', 'c', 'x', 'id', 'name', 'k', NULL, NULL, NULL]) AS local, unnest([NULL, 'true', 'false', '' || c_custkey, NULL, 'v', c_name, NULL, NULL]) AS value, unnest(['c', NULL, NULL, '', 'x', 'c', NULL, NULL, NULL]) AS prefix FROM customer""")
def prefixes_kept(spark, d):
    """Namespace declarations and prefixes through documents that keep them."""
    k = F.col("c_custkey").cast("string")
    xml = F.concat(F.lit('<c:customer xmlns:c="urn:c" xmlns:x="urn:'), (F.col("c_custkey") % 3).cast("string"), F.lit('" id="'), k, F.lit('"><x:name c:k="v">'), F.col("c_name"), F.lit("</x:name></c:customer>"))
    o = Options(prefixes=True)
    docs = exi.encode_xml(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), xml.alias("xml")), options=o)
    return exi.event_rows(exi.decode_events(docs, o), "key").withColumn("seq", long("seq"))


@query("SELECT o_orderkey AS key, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total, CASE o_orderkey % 2 WHEN 0 THEN '0' ELSE '1' END AS flag, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def lexical_values(spark, d):
    """Spellings that typed values would lose, kept as text of restricted sets."""
    schema = T.StructType.fromDDL("key BIGINT, total DECIMAL(18,2), flag BOOLEAN, day DATE")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("<o><key>"), F.col("o_orderkey"), F.lit("</key><total>"), F.col("o_totalprice").cast("decimal(18,2)"), F.lit("</total><flag>"), F.col("o_orderkey") % 2, F.lit("</flag><day>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</day></o>")).alias("xml"))
    o, s = Options(lexical=True, prefixes=True), Schema.of(schema, "o")
    back = exi.decode_xml(exi.encode_xml(rows, options=o, schema=s), o, schema=s)
    text = lambda c: F.regexp_extract("xml", f"<{c}>([^<]*)</{c}>", 1).alias(c)
    return back.select("key", text("total"), text("flag"), text("day"))


@query("SELECT o_orderkey AS key, CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderstatus AS status FROM orders")
def represented_roundtrip(spark, d):
    """A datatype representation map: decimals as strings, in the header too."""
    base = T.StructType([T.StructField("key", T.LongType()), T.StructField("total", T.DecimalType(18, 2)), T.StructField("status", T.StringType())])
    schema = represented(base, {"decimal": "string"})
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.col("o_orderstatus").alias("status"))
    o = Options(strict=True, with_options=True, representations=(("{http://www.w3.org/2001/XMLSchema}decimal", "{http://www.w3.org/2009/exi}string"),))
    return exi.decode_rows(exi.encode_rows(rows, "o", o, schema), "o", schema, o)


@query("SELECT event_id AS key, strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def utc_on_write(spark, d):
    """Times with a zone are written in UTC if asked for."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("at", T.StringType(), True, {"xsd": "dateTime"})])
    rows = table(spark, d, "events").select(F.col("event_id").alias("key"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")).alias("at"))
    o = Options(strict=True, utc=True)
    return exi.decode_rows(exi.encode_rows(rows, "e", o, schema), "e", schema, o)


@query("SELECT c_custkey AS key, 'customer' AS root, c_name AS name, CAST(NULL AS BIGINT) AS size FROM customer UNION ALL SELECT p_partkey, 'part', NULL, CAST(p_size AS BIGINT) FROM part")
def rows_by_root(spark, d):
    """Documents of two kinds in one column, told apart by their root element."""
    schemas = {"customer": T.StructType.fromDDL("c_name STRING"), "part": T.StructType.fromDDL("p_size BIGINT")}
    one = exi.encode_xml(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), _xml("c_name").alias("xml")), options=Options(), schema=_both(schemas))
    two = exi.encode_xml(table(spark, d, "part").select(F.col("p_partkey").alias("key"), _xml("p_size", root="part").alias("xml")), options=Options(), schema=_both(schemas))
    back = exi.decode_by_root(one.unionByName(two), schemas, Options())
    return back.select("key", "root", F.col("customer.c_name").alias("name"), F.col("part.p_size").alias("size"))


def _both(schemas: dict[str, T.StructType]) -> Schema:
    return Schema({("", n): T.StructField(n, s, False, {}) for n, s in schemas.items()})


@query("SELECT n_nationkey AS n_nationkey, n_name, n_regionkey FROM nation")
def schema_less_rows(spark, d):
    """Rows through documents without a schema, where everything is text, found again by names in any case."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    upper = T.StructType([T.StructField(f.name.upper(), f.dataType) for f in rows.schema])
    docs = exi.encode_rows(rows, "nation", Options(), informed=False)
    back = exi.decode_rows(docs, "nation", upper, Options(), informed=False)
    return back.toDF(*rows.columns)


STRING_LENGTH = O.uint("length(value) + 2")


@query(O.table("SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS seq, 'q' || (l_linenumber % 2) AS ctx, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value FROM lineitem") + f"SELECT doc_id, seq, hit, CASE hit WHEN 'local' THEN '00000000' || {O.nbit('local_id', O.width('local_size'))} WHEN 'global' THEN '00000001' || {O.nbit('global_id', O.width('global_size'))} ELSE {STRING_LENGTH} || {O.charset('value', V.CHARSETS['integer'])} END AS bits FROM t")
def charset_table(spark, d):
    """Restricted sets behind the value table: hits as ever, misses spelled by the set."""
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), long(F.row_number().over(by)).alias("seq"), F.concat(F.lit("q"), F.col("l_linenumber") % 2).alias("ctx"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    return D.value_table(rows).select("doc_id", "seq", "hit", D.value_bits(V.CHARSETS["integer"]).alias("bits"))


@query(O.table(f"SELECT * FROM ({O.STRINGS}) WHERE value NOT IN ('user', 'assistant', 'system')") + f"""SELECT doc_id, seq, hit, CASE hit WHEN 'local' THEN '00000000' || {O.nbit('local_id', O.width('local_size'))} WHEN 'global' THEN '00000001' || {O.nbit('global_id', O.width('global_size'))} ELSE {O.uint('length(value) + 6')} || {O.codes('value')} END AS bits FROM t
UNION ALL SELECT doc_id, seq, 'member', '00000010' || CASE value WHEN 'user' THEN '00' WHEN 'assistant' THEN '01' ELSE '10' END FROM ({O.STRINGS}) WHERE value IN ('user', 'assistant', 'system')""")
def extended_strings(spark, d):
    return D.extended_table(turns(spark, d), ["user", "assistant", "system"]).select("doc_id", "seq", "hit", "bits")


NAMED = "SELECT user_id AS doc_id, event_id AS seq, 'urn:' || (event_id % 5) AS uri, event_type AS name FROM events"


@query(names(3, "uri", NAMED).replace("SELECT doc_id, seq, uri,", "SELECT doc_id, seq, uri, name,") + f""", b AS (SELECT doc_id, seq, uri, name, CASE WHEN known THEN {O.nbit('id + 1', O.width('size + 1'))} ELSE {O.nbit('0', O.width('size + 1'))} || {O.text('uri')} END AS ub FROM t),
f2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, uri, name ORDER BY seq) AS n FROM b), s2 AS (SELECT *, coalesce(sum((n = 1)::INT) OVER (PARTITION BY doc_id, uri ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM f2),
t2 AS (SELECT *, n > 1 AS known, first_value(z) OVER (PARTITION BY doc_id, uri, name ORDER BY seq) AS id FROM s2) SELECT doc_id, seq, uri, name, ub || CASE WHEN known THEN '00000000' || {O.nbit('id', O.width('z'))} ELSE {O.text('name', 1)} END AS bits FROM t2""")
def qname_bits(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.concat(F.lit("urn:"), F.col("event_id") % 5).alias("uri"), F.col("event_type").alias("name"))
    return D.qname_table(rows, list(GIVEN))


PREFIXED = "SELECT user_id AS doc_id, event_id AS seq, 'urn:' || (event_id % 2) AS uri, 'p' || (event_id % 3) AS prefix FROM events"


@query(names(0, "prefix", PREFIXED, "doc_id, uri") + f"SELECT doc_id, uri, seq, prefix, known, id, size, CASE WHEN known THEN {O.nbit('id + 1', O.width('size + 1'))} ELSE {O.nbit('0', O.width('size + 1'))} || {O.text('prefix')} END AS bits, {O.nbit('id', O.width('size + CASE WHEN known THEN 0 ELSE 1 END'))} AS use_bits FROM t")
def prefix_table(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.concat(F.lit("urn:"), F.col("event_id") % 2).alias("uri"), F.concat(F.lit("p"), F.col("event_id") % 3).alias("prefix"))
    return D.prefix_table(rows)


@query("SELECT c_custkey AS doc_id, CAST(unnest([1, 2, 3, 5, 6]) AS BIGINT) AS seq, 'p' AS prefix, unnest(['urn:root', 'urn:root', 'urn:root', 'urn:' || (c_custkey % 2), 'urn:' || (c_custkey % 2)]) AS uri FROM customer")
def scope_lookup(spark, d):
    """Prefixes by the innermost element that declares them: the root, and an inner one."""
    events = E.from_rows(table(spark, d, "customer"), F.col("c_custkey"), "customer", ["c_name", "c_mktsegment"])
    at = events.where("event in ('SE', 'CH')").select("doc_id", "seq", F.lit("p").alias("prefix"))
    uri = F.when(F.col("seq") == 1, "urn:root").otherwise(F.concat(F.lit("urn:"), F.col("doc_id") % 2))
    declared = events.where("event = 'SE' and seq in (1, 5)").select("doc_id", "seq", F.lit("p").alias("prefix"), uri.alias("uri"))
    return E.in_scope(at, declared, events, "prefix", "uri")


@query("""SELECT c_custkey AS doc_id, CAST(unnest(CASE WHEN c_custkey % 2 = 0 THEN [1, 2, 3, 4, 6, 7, 8] ELSE [1, 2, 3, 6, 7, 8] END) AS BIGINT) AS seq, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['SE', 'SE', 'CH', 'CH2', 'EE', 'CH3', 'EE2'] ELSE ['SE', 'SE', 'CH', 'EE', 'CH3', 'EE2'] END) AS what FROM customer WHERE false
UNION ALL SELECT c_custkey, CAST(unnest([1, 2, 3, 5, 7]) AS BIGINT), unnest(['SE', 'SE', 'CH:' || c_name || c_mktsegment, 'EE', 'EE']) FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT c_custkey, CAST(unnest([1, 2, 3, 5, 6, 7]) AS BIGINT), unnest(['SE', 'SE', 'CH:' || c_name || c_mktsegment, 'EE', 'CH: ', 'EE']) FROM customer WHERE c_custkey % 2 = 0""")
def text_coalescing(spark, d):
    """Adjacent text is one; white space alone between elements is dropped, but not under xml:space preserve."""
    row = lambda seq, event, value=None: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(event).alias("event"), F.lit(None).cast("string").alias("local"), (F.lit(None) if value is None else value).cast("string").alias("value"))
    rows = F.array(row(1, "SE"), row(2, "SE"), row(3, "CH", F.col("c_name")), row(4, "CH", F.col("c_mktsegment")), row(5, "EE"), row(6, "CH", F.lit(" ")), row(7, "EE"))
    events = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(rows).alias("e")).select("doc_id", "e.*")
    kept = E.coalesced(events, F.col("doc_id") % 2 == 0)
    return kept.select("doc_id", "seq", F.concat_ws(":", "event", F.when(F.col("event") == "CH", F.col("value"))).alias("what"))
