"""The library's queries, each with the tables it reads and, where there is one, its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirespark.functions import bits as B
from wirespark.functions import names as Q
from wirespark.functions import numbers as N
from wirespark.functions import times as M
from wirespark.functions import values as V
from wirespark.operators import dictionary as D
from wirespark.operators import events as E
from wirespark.operators import grammar as G
from wirespark.plans import oracle as O
from wirespark.plans.registry import ORACLE_SQL, QUERIES, long, query, table
from wirespark.sources import exi
from wirespark.sources.codec import Options


KEYS = "SELECT DISTINCT l_orderkey AS n FROM lineitem"


@query(f"SELECT n, CAST({O.width('n')} AS BIGINT) AS width, CAST((length(bin(n)) + 6) // 7 AS BIGINT) AS groups FROM ({KEYS})")
def bit_width(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("n")).distinct()
    return n.select("n", long(B.width(F.col("n"))).alias("width"), long(B.groups(F.col("n"))).alias("groups"))


@query(f"SELECT n, {O.uint('n')} AS bits FROM ({KEYS})")
def uint_groups(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("n")).distinct().select("n", B.unsigned(F.col("n")).alias("bits"))


@query(f"SELECT o_orderkey AS key, 700 - o_custkey AS n, {O.sint('700 - o_custkey')} AS bits FROM orders")
def int_sign_magnitude(spark, d):
    n = 700 - F.col("o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), n.alias("n"), B.integer(n).alias("bits"))


@query(f"SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS line, {O.nbit('l_linenumber', 3)} AS bits, {O.nbit('l_partkey & 255', 8)} || {O.nbit('(l_partkey >> 8) & 255', 8)} || {O.nbit('(l_partkey >> 16) & 255', 8)} AS bytes FROM lineitem")
def nbit_channels(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), long("l_linenumber").alias("line"), B.nbit(F.col("l_linenumber"), 3).alias("bits"), B.byte_aligned(F.col("l_partkey"), 20).alias("bytes"))


@query("SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS value, CAST((l_linenumber * 3 + 7) // 8 * 8 AS BIGINT) AS next FROM lineitem")
def bit_read(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), long("l_linenumber").alias("line"), B.pack(F.concat(B.nbit(F.col("l_linenumber"), 3), B.nbit(F.col("l_partkey"), 30))).alias("data"))
    return rows.select("key", "line", B.read(B.unpack(F.col("data")), F.lit(3), 30).alias("value"), B.aligned(F.col("line") * 3).alias("next"))


PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"


@query(f"""SELECT o_orderkey AS key, t AS text, starts_with(t, '-') AS negative, CAST(split_part(ltrim(t, '-'), '.', 1) AS BIGINT) AS whole, CAST(reverse(split_part(t, '.', 2)) AS BIGINT) AS fraction,
(CASE WHEN starts_with(t, '-') THEN '1' ELSE '0' END) || {O.uint("CAST(split_part(ltrim(t, '-'), '.', 1) AS BIGINT)")} || {O.uint("CAST(reverse(split_part(t, '.', 2)) AS BIGINT)")} AS bits FROM (SELECT o_orderkey, {PRICE} AS t FROM orders)""")
def decimal_parts(spark, d):
    t = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), t.alias("text"), N.decimal_parts(t).alias("p"))
    return rows.select("key", "text", "p.*", N.decimal_bits(F.col("p")).alias("bits"))


@query("""SELECT s_suppkey AS key, w || '.' || CASE WHEN f = '' THEN '0' ELSE f END AS text FROM (SELECT s_suppkey, split_part(t, '.', 1) AS w, rtrim(split_part(t, '.', 2), '0') AS f FROM
(SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS t FROM supplier))""")
def decimal_canonical(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), N.decimal_text(F.col("s_acctbal").cast("decimal(18,2)").cast("string")).alias("text"))


FLOAT = """SELECT t AS text, CASE WHEN digits = '' THEN 0 ELSE CAST(rtrim(digits, '0') AS BIGINT) END AS mantissa, CAST(CASE WHEN digits = '' THEN 0 ELSE length(digits) - length(rtrim(digits, '0')) - 2 END AS BIGINT) AS exponent
FROM (SELECT t, ltrim(replace(t, '.', ''), '0') AS digits FROM (SELECT DISTINCT CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS t FROM lineitem UNION SELECT DISTINCT CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) FROM lineitem))"""


@query(f"SELECT *, {O.sint('mantissa')} || {O.sint('exponent')} AS bits, mantissa || 'E' || exponent AS canonical FROM ({FLOAT})")
def float_canonical(spark, d):
    lines = table(spark, d, "lineitem")
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string").alias("text")
    t = lines.select(text("l_discount")).union(lines.select(text("l_quantity"))).distinct()
    rows = t.select("text", N.float_parts(F.col("text")).alias("p"))
    return rows.select("text", "p.mantissa", long("p.exponent").alias("exponent"), N.float_bits(F.col("p")).alias("bits"), N.float_text(F.col("p")).alias("canonical"))


MICROS = "date_part('microseconds', ts) % 1000000"
FRACTION = f"CASE WHEN {MICROS} = 0 THEN NULL ELSE CAST(reverse(rtrim(lpad(CAST({MICROS} AS VARCHAR), 6, '0'), '0')) AS BIGINT) END"
PACKED = f"""SELECT event_id AS key, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) * 32 + day(ts) AS BIGINT) AS month_day, CAST((hour(ts) * 64 + minute(ts)) * 64 + second(ts) AS BIGINT) AS time, {FRACTION} AS fraction FROM events"""


@query(f"SELECT *, {O.sint('year - 2000')} || {O.nbit('month_day', 9)} || {O.nbit('time', 17)} || CASE WHEN fraction IS NULL THEN '0' ELSE '1' || {O.uint('fraction')} END || '1' || {O.nbit('896', 11)} AS bits FROM ({PACKED})")
def datetime_pack(spark, d):
    t = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("key"), M.parts(t, "dateTime").alias("p"))
    wire = rows.select("key", "p", M.wire_parts(F.col("p")).alias("w"))
    return wire.select("key", *[long(f"w.{c}").alias(c) for c in ("year", "month_day", "time", "fraction")], M.wire(F.col("p"), "dateTime").alias("bits"))


@query("SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(day(o_orderdate) AS BIGINT) AS day FROM orders")
def datetime_unpack(spark, d):
    bits = M.datetime(F.date_format("o_orderdate", "yyyy-MM-dd"), "date")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), bits.alias("b")).withColumn("y", B.read_integer(F.col("b"), F.lit(0)))
    parts = rows.select("key", (F.col("y.value") + 2000).alias("year"), B.read(F.col("b"), F.col("y.next"), 9).alias("md"))
    parts = parts.select("key", "year", F.floor(F.col("md") / 32).alias("month"), F.pmod("md", F.lit(32)).alias("day"))
    return parts.select("key", F.date_format(F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int")), "yyyy-MM-dd").alias("date"), "year", long("month").alias("month"), long("day").alias("day"))


@query("SELECT event_id AS key, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def datetime_utc(spark, d):
    t = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    return table(spark, d, "events").select(F.col("event_id").alias("key"), M.to_utc(t).alias("utc"))


@query("SELECT o_orderkey AS key, CAST(day(last_day(CAST(o_orderdate AS DATE))) AS BIGINT) AS days, CAST(((o_custkey - 7) % 13 + 13) % 13 + 7 AS BIGINT) AS modulo, CAST(floor((o_custkey - 7) / 13) AS BIGINT) AS quotient FROM orders")
def duration_helpers(spark, d):
    a = F.col("o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), long(M.days_in_month(F.year("o_orderdate"), F.month("o_orderdate"))).alias("days"), long(M.modulo(a, 7, 20)).alias("modulo"), long(M.quotient(a, 7, 20)).alias("quotient"))


@query("SELECT doc_id, CASE quality WHEN 1 THEN '10' ELSE '00' END AS facet, CASE toxic WHEN 1 THEN '11' ELSE '01' END AS digit, toxic = 1 AS value, CAST(quality AS VARCHAR) AS bit FROM labels")
def boolean_facet(spark, d):
    word, digit = F.when(F.col("quality") == 1, " true ").otherwise("false"), F.col("toxic").cast("string")
    return table(spark, d, "labels").select("doc_id", B.nbit(V.boolean_facet(word), 2).alias("facet"), B.nbit(V.boolean_facet(digit), 2).alias("digit"), V.boolean(digit).alias("value"), V.boolean_bit(word).alias("bit"))


@query("SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS line, CASE l_returnflag WHEN 'A' THEN '00' WHEN 'N' THEN '01' WHEN 'R' THEN '10' END AS flag, CASE l_linestatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' END AS status FROM lineitem")
def enum_ordinal(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), long("l_linenumber").alias("line"), V.enumeration(F.col("l_returnflag"), ["A", "N", "R"]).alias("flag"), V.enumeration(F.col("l_linestatus"), ["F", "O"]).alias("status"))


@query(f"SELECT p_partkey AS key, CASE WHEN p_size BETWEEN 5 AND 40 THEN {O.nbit('p_size - 5', 6)} END AS bits FROM part")
def nbit_bounded(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), V.bounded(F.col("p_size"), 5, 40).alias("bits"))


@query(f"SELECT p_partkey AS key, CAST(len(ts) AS BIGINT) AS n, array_to_string(ts, ' ') AS text, {O.uint('len(ts)')} || array_to_string(list_transform(ts, lambda t: {O.uint('length(t)')}), '') AS bits FROM (SELECT p_partkey, string_split(p_name, ' ') AS ts FROM part)")
def list_tokens(spark, d):
    ts = V.list_tokens(F.concat(F.lit(" \t"), F.col("p_name"), F.lit("\n")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), long(F.size(ts)).alias("n"), F.array_join(ts, " ").alias("text"), V.list_of(F.col("p_name"), lambda t: B.unsigned(F.char_length(t))).alias("bits"))


@query("SELECT n_nationkey AS key, lower(hex(encode(n_name))) AS hex, to_base64(encode(n_name)) AS base64, CAST((length(n_name) + 2) // 3 * 4 AS BIGINT) AS base64_length FROM nation")
def binary_text(spark, d):
    b = F.col("n_name").cast("binary")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.lower(F.hex(b)).alias("hex"), F.base64(b).alias("base64"))
    return rows.withColumn("base64_length", long(F.length("base64"))).where(F.unhex("hex") == F.try_to_binary("base64", F.lit("base64")))


@query(f"SELECT n_nationkey AS key, {O.uint('strlen(n_name)')} || array_to_string(list_transform(string_split(n_name, ''), lambda c: {O.nbit('unicode(c)', 8)}), '') AS bits FROM nation")
def binary_bits(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), V.binary(F.col("n_name").cast("binary")).alias("bits"))


@query(f"SELECT c_custkey AS key, {O.text('c_name')} AS bits, CAST(length(c_name) AS BIGINT) AS n FROM customer")
def string_bits(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), V.string(F.col("c_name")).alias("bits"), long(F.char_length("c_name")).alias("n"))


@query(f"SELECT o_orderkey AS key, {O.uint('length(t) + 2')} || {O.charset('t', V.CHARSETS['decimal'])} AS decimal, {O.uint('length(o_orderpriority) + 2')} || {O.charset('o_orderpriority', V.CHARSETS['hex'])} AS hex FROM (SELECT *, {PRICE} AS t FROM orders)")
def charset_codes(spark, d):
    t = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), V.charset_string(t, V.CHARSETS["decimal"]).alias("decimal"), V.charset_string(F.col("o_orderpriority"), V.CHARSETS["hex"]).alias("hex"))


@query(f"SELECT doc_id, md5({O.collapse('text')}) AS collapsed, md5(regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')) AS replaced FROM documents")
def ws_facets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(V.collapse_space(F.col("text"))).alias("collapsed"), F.md5(V.replace_space(F.col("text"))).alias("replaced"))


WHOLE = "regexp_full_match(text, '[ \\t\\r\\n]*') AS only, CAST(length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS BIGINT) AS lead, CAST(length(text) - length(rtrim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS BIGINT) AS trail"


@query(f"SELECT 'documents' AS source, doc_id AS key, CAST(NULL AS BIGINT) AS turn, {WHOLE} FROM documents UNION ALL SELECT 'conversations', conv_id, turn, {WHOLE} FROM conversations")
def ws_tests(spark, d):
    tests = lambda x: (V.only_space(x).alias("only"), long(V.leading_space(x)).alias("lead"), long(V.trailing_space(x)).alias("trail"))
    docs = table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("key"), long(F.lit(None)).alias("turn"), *tests(F.col("text")))
    return docs.unionByName(table(spark, d, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("key"), "turn", *tests(F.col("text"))))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'ns' || (c_custkey % 3) END AS prefix, c_mktsegment AS local FROM customer")
def qname_split(spark, d):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ns"), F.col("c_custkey") % 3, F.lit(":"))).otherwise(""), F.col("c_mktsegment"))
    q = Q.qname(name)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), q["prefix"].alias("prefix"), q["local"].alias("local"))


VALID = "split_part(o_orderpriority, '-', 1)"


@query(f"SELECT o_orderkey AS key, CAST(TRY_CAST({VALID} AS BIGINT) AS BIGINT) AS number, TRY_CAST(o_orderpriority AS BIGINT) IS NOT NULL AS whole_valid, CASE WHEN TRY_CAST({VALID} AS BIGINT) BETWEEN 2 AND 4 THEN 'typed' ELSE 'untyped' END AS branch FROM orders")
def typed_validate(spark, d):
    first = V.parsed_integer(F.concat(F.lit(" +"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), F.lit(" ")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), long(first).alias("number"), V.parsed_integer(F.col("o_orderpriority")).isNotNull().alias("whole_valid"), F.when(V.bounded(long(first), 2, 4).isNotNull(), "typed").otherwise("untyped").alias("branch"))


@query(O.events("nation", "n_nationkey", "nation", ["n_nationkey", "n_name", "n_regionkey"]))
def events_from_rows(spark, d):
    return E.from_rows(table(spark, d, "nation"), F.col("n_nationkey"), "nation", ["n_nationkey", "n_name", "n_regionkey"])


@query(f"""WITH e AS ({O.events("customer", "c_custkey", "customer", ["c_name", "c_mktsegment"])}), s AS (SELECT *, sum(CASE event WHEN 'SE' THEN 1 WHEN 'EE' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS up FROM e)
SELECT doc_id, seq, event, local, value, CAST(up + (event = 'EE')::INT AS BIGINT) AS depth, CAST(CASE WHEN event IN ('SD', 'ED') OR local = 'customer' THEN NULL WHEN event IN ('SE', 'EE') THEN 1 ELSE seq - 1 END AS BIGINT) AS parent_seq FROM s""")
def event_depth(spark, d):
    return E.with_depth(E.from_rows(table(spark, d, "customer"), F.col("c_custkey"), "customer", ["c_name", "c_mktsegment"]))


@query("""SELECT p_partkey AS key, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY r, local) AS BIGINT) AS pos, local, value FROM (
SELECT p_partkey, 3 AS r, 'size' AS local, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 3, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 1, 'type', p_type FROM part UNION ALL SELECT p_partkey, 2, 'nil', 'true' FROM part WHERE p_partkey % 2 = 1)""")
def attribute_order(spark, d):
    xsi = F.lit("http://www.w3.org/2001/XMLSchema-instance")
    at = lambda ns, local, v: F.struct(ns.alias("ns"), F.lit(local).alias("local"), v.cast("string").alias("value"))
    given = F.array(at(F.lit(""), "size", F.col("p_size")), at(xsi, "nil", (F.col("p_partkey") % 2 == 1)), at(F.lit(""), "brand", F.col("p_brand")), at(xsi, "schemaLocation", F.lit("x")), at(xsi, "type", F.col("p_type")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.posexplode(E.ordered_attributes(given)).alias("pos", "a"))
    return rows.select("key", long(F.col("pos") + 1).alias("pos"), "a.local", "a.value")


def turns(spark, d):
    one = lambda name, k: F.struct((2 * F.col("turn") + k).alias("seq"), F.lit(name).alias("ctx"), F.col(name).alias("value"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.explode(F.array(one("role", 0), one("text", 1))).alias("v")).select("doc_id", "v.*")


@query(O.table(O.STRINGS) + f"SELECT *, {O.VALUE_BITS} AS bits FROM t")
def string_table_hits(spark, d):
    return D.value_table(turns(spark, d)).withColumn("bits", D.value_bits())


@query(O.table(f"SELECT * FROM ({O.STRINGS}) UNION ALL SELECT DISTINCT conv_id, unnest([-2, -1]), NULL, unnest(['user', 'system']) FROM conversations") + f"SELECT *, {O.VALUE_BITS} AS bits FROM t WHERE seq >= 0")
def string_table_shared(spark, d):
    return D.value_table(D.seeded(turns(spark, d), ["user", "system"])).withColumn("bits", D.value_bits()).where("seq >= 0")


@query(O.BOUNDED)
def string_table_bounded(spark, d):
    return D.bounded_table(turns(spark, d), capacity=4, max_length=200)


def names(given: int, column: str, source: str, keys: str = "doc_id") -> str:
    return f"""WITH v AS ({source}), f AS (SELECT *, row_number() OVER (PARTITION BY {keys}, {column} ORDER BY seq) AS n FROM v),
s AS (SELECT *, coalesce(sum((n = 1)::INT) OVER (PARTITION BY {keys} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {given} AS z FROM f),
t AS (SELECT {keys}, seq, {column}, n > 1 AS known, CAST(first_value(z) OVER (PARTITION BY {keys}, {column} ORDER BY seq) AS BIGINT) AS id, CAST(z AS BIGINT) AS size FROM s) """


@query(names(0, "name", "SELECT user_id AS doc_id, event_id AS seq, event_type AS name FROM events") + f"SELECT *, CASE WHEN known THEN '00000000' || {O.nbit('id', O.width('size'))} ELSE {O.text('name', 1)} END AS bits FROM t")
def local_name_table(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"))
    return D.name_table(rows, ["doc_id"], "name").withColumn("bits", D.local_name_bits("name"))


@query(names(3, "uri", "SELECT user_id AS doc_id, event_id AS seq, 'urn:' || (event_id % 5) AS uri FROM events") + f"SELECT *, CASE WHEN known THEN {O.nbit('id + 1', O.width('size + 1'))} ELSE {O.nbit('0', O.width('size + 1'))} || {O.text('uri')} END AS bits FROM t")
def uri_table(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.concat(F.lit("urn:"), F.col("event_id") % 5).alias("uri"))
    return D.name_table(rows, ["doc_id"], "uri", ["", "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2001/XMLSchema-instance"]).withColumn("bits", D.uri_bits("uri"))


@query("""WITH a AS (SELECT user_id AS doc_id, event_id AS seq, event_type AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), b AS (SELECT * FROM a WHERE k > 1),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY seq) AS o FROM b), e AS (SELECT *, 1 + coalesce(sum((o = 1)::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM c)
SELECT doc_id, seq, name, o > 1 AS known, CAST(CASE WHEN o = 1 THEN n ELSE n - 1 - first_value(n) OVER (PARTITION BY doc_id, name ORDER BY seq) END AS BIGINT) AS code, CAST(length(bin(CAST(n AS BIGINT))) AS BIGINT) AS width FROM e""")
def learned_codes(spark, d):
    return D.learned_codes(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name")))


@query("""WITH t AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM (SELECT conv_id, turn // 2 AS half, turn, CASE WHEN turn % 3 = 0 THEN 'a' ELSE role END AS role, text FROM conversations)),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t) SELECT conv_id, role, min(turn) AS turn, string_agg(text, '' ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role""")
def text_merge(spark, d):
    rows = table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, "a").otherwise(F.col("role")))
    return E.merged_text(rows, "conv_id", "turn", "role", "text")


ORDER = T.StructType([T.StructField(n, t, n != "o_orderpriority") for n, t in (("o_orderkey", T.LongType()), ("o_custkey", T.LongType()), ("o_orderstatus", T.StringType()), ("o_orderpriority", T.StringType()))])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def exi_roundtrip(spark, d):
    priority = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", priority)
    return exi.decode_rows(exi.encode_rows(rows, "order"), "order", rows.schema)


@query("""SELECT o_orderkey AS key, o_orderkey % 2 = 1 AS cookie, o_orderkey % 3 = 0 AS options, CAST(0 AS BIGINT) AS version, o_orderkey % 5 <> 0 AS valid FROM orders""")
def header_parse(spark, d):
    k = F.col("o_orderkey")
    start = F.when(k % 5 == 0, "01").otherwise("10")
    bits = F.concat(F.when(k % 2 == 1, B.unpack(F.lit("$EXI").cast("binary"))).otherwise(""), start, F.when(k % 3 == 0, "1").otherwise("0"), F.lit("00000"), F.when(k % 3 == 0, "010").otherwise(""))
    h = exi.header(F.col("content"))
    return table(spark, d, "orders").select(k.alias("key"), B.pack(bits).alias("content")).select("key", h["cookie"].alias("cookie"), h["options"].alias("options"), long(h["version"]).alias("version"), h["valid"].alias("valid"))


@query("""WITH p AS (SELECT o_orderkey AS key, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 0 END, CASE WHEN o_orderkey % 3 = 0 THEN 1 END, CASE WHEN o_custkey % 2 = 0 THEN 2 END, 3], lambda x: x IS NOT NULL) AS h FROM orders),
e AS (SELECT key, h, unnest(range(1, len(h) + 1)) AS i FROM p), s AS (SELECT key, h[i] AS field, CASE WHEN i = 1 THEN 0 ELSE h[i - 1] + 1 END AS state FROM e)
SELECT key, CAST(field AS BIGINT) AS field, CAST(field - state AS BIGINT) AS code, CAST(CASE 4 - state WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS width FROM s""")
def event_codes_strict(spark, d):
    codes = G.optional_codes([F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 2 == 0])
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.explode(codes).alias("e")).select("key", "e.*")


# the others register themselves
from wirespark.plans import documents, grammars, scalars  # noqa: E402, F401
