"""Queries of values: integers, decimals, floats, dates and times, names, lists, restricted sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirespark.functions import bits as B
from wirespark.functions import names as Q
from wirespark.functions import numbers as N
from wirespark.functions import times as M
from wirespark.functions import values as V
from wirespark.plans import oracle as O
from wirespark.plans.registry import long, query, table

#: A bit string of an order's key and customer behind three bits, unaligned.
SHIFTED = f"'101' || {O.nbit('o_orderkey', 32)} || {O.uint('o_custkey')} || {O.sint('o_custkey - 700')}"


@query(f"SELECT o_orderkey AS key, o_orderkey AS number, CAST(o_custkey AS BIGINT) AS customer, CAST(o_custkey - 700 AS BIGINT) AS difference, {O.packed(O.nbit('o_orderkey', 32))} AS octets, CAST((o_orderkey >> 3) & 255 AS BIGINT) AS ahead, CAST(NULL AS BIGINT) AS none FROM orders")
def bit_stream(spark, d):
    """Integers, octets from any bit, and the byte ahead, read back from a bit string; no bits, or bits that aren't there, are invalid."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bits = F.concat(F.lit("101"), B.nbit(k, 32), B.unsigned(c), B.integer(c - 700))
    rows = table(spark, d, "orders").select(k.alias("key"), B.unpack(B.pack(bits)).alias("b"))
    rows = rows.withColumn("u", B.read_unsigned(F.col("b"), F.lit(35))).withColumn("i", B.read_integer(F.col("b"), F.col("u.next")))
    ahead = B.look_ahead(F.substring(F.col("b"), 1, 32), F.lit(24))  # the last 5 bits before it and 3 of the shift
    return rows.select("key", B.read(F.col("b"), F.lit(3), 32).alias("number"), F.col("u.value").alias("customer"), F.col("i.value").alias("difference"), F.hex(B.read_bytes(F.col("b"), F.lit(3), 4)).alias("octets"), ahead.alias("ahead"), F.coalesce(B.read(F.col("b"), F.lit(0), 0), B.read(F.col("b"), F.lit(9000), 3)).alias("none"))


BIG = "CAST(o_orderkey AS DECIMAL(38,0)) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 10000000 WHEN 2 THEN 10000000000000000 ELSE -1 END"


@query(f"""SELECT key, CAST(n AS VARCHAR) AS text, CASE WHEN digits < 10 THEN '32' WHEN digits < 19 THEN '64' ELSE 'big' END AS width,
CASE WHEN n BETWEEN -2147483648 AND 2147483647 THEN '32' WHEN n BETWEEN -9223372036854775808 AND 9223372036854775807 THEN '64' ELSE 'big' END AS narrow, CAST(n + c AS VARCHAR) AS sum, CAST(n - c AS VARCHAR) AS difference,
CAST(CASE WHEN n < c THEN -1 WHEN n = c THEN 0 ELSE 1 END AS BIGINT) AS compared, CAST(CASE WHEN n < 0 THEN -1 WHEN n = 0 THEN 0 ELSE 1 END AS BIGINT) AS sign, CASE WHEN n >= 0 THEN reverse(CAST(n AS VARCHAR)) END AS reversed, CAST(length(CAST(n AS VARCHAR)) AS BIGINT) AS length
FROM (SELECT o_orderkey AS key, {BIG} AS n, CAST(o_custkey AS DECIMAL(38,0)) AS c, length(ltrim(CAST({BIG} AS VARCHAR), '-')) AS digits FROM orders)""")
def integer_values(spark, d):
    k = F.col("o_orderkey")
    factor = F.when(k % 4 == 0, "1").when(k % 4 == 1, "10000000").when(k % 4 == 2, "10000000000000000").otherwise("-1").cast("decimal(18,0)")
    text = (k.cast("decimal(19,0)") * factor).cast("decimal(38,0)").cast("string")
    rows = table(spark, d, "orders").select(k.alias("key"), N.integer_value(F.concat(F.lit(" "), F.when(text.startswith("-"), "").otherwise("+"), text, F.lit("\t"))).alias("v"), F.col("o_custkey").alias("c"))
    n, c = F.col("v.value"), F.col("c")
    return rows.select("key", "v.text", "v.width", N.narrowest(n).alias("narrow"), N.digits(N.add(n, c)).alias("sum"), N.digits(N.subtract(n, c)).alias("difference"), long(N.compare(n, c)).alias("compared"), long(N.sign(n)).alias("sign"), N.reversed_digits(n).alias("reversed"), long(N.text_length(n)).alias("length"))


@query("""SELECT s_suppkey AS key, CASE s_suppkey % 5 WHEN 0 THEN '0.0' WHEN 1 THEN '0.5' WHEN 2 THEN NULL WHEN 3 THEN CAST(s_suppkey AS VARCHAR) || '.0' ELSE '-' || CAST(s_suppkey AS VARCHAR) || '.25' END AS text,
CASE s_suppkey % 5 WHEN 2 THEN NULL ELSE s_suppkey % 5 = 4 END AS negative FROM supplier""")
def decimal_forms(spark, d):
    """Minus zero, no digit before the point, none behind it (which is invalid), no point, needless zeros."""
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, "-0.00").when(k % 5 == 1, "+.50").when(k % 5 == 2, "1.").when(k % 5 == 3, k.cast("string")).otherwise(F.concat(F.lit("-0"), k.cast("string"), F.lit(".2500")))
    return table(spark, d, "supplier").select(k.alias("key"), N.decimal_text(text).alias("text"), N.decimal_parts(text)["negative"].alias("negative"))


MANTISSA = "CASE WHEN k % 7 = 0 THEN 1 WHEN k % 7 = 1 THEN -1 WHEN k % 7 = 2 OR c = 0 THEN 0 ELSE CAST(rtrim(CAST(c AS VARCHAR), '0') AS BIGINT) * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END END"
EXPONENT = "CASE WHEN k % 7 < 3 THEN -16384 WHEN c = 0 THEN 0 ELSE k % 11 - 5 - 2 + length(CAST(c AS VARCHAR)) - length(rtrim(CAST(c AS VARCHAR), '0')) END"


@query(f"""SELECT *, {O.sint('mantissa')} || {O.sint('exponent')} AS bits, CASE WHEN exponent = -16384 THEN (CASE mantissa WHEN 1 THEN 'INF' WHEN -1 THEN '-INF' ELSE 'NaN' END) ELSE mantissa || 'E' || exponent END AS canonical,
CASE WHEN exponent > -16384 THEN CAST(mantissa || 'E' || exponent AS DOUBLE) END AS number, true AS same, exponent = -16384 AS unlike FROM (SELECT k AS key, CAST({MANTISSA} AS BIGINT) AS mantissa, CAST({EXPONENT} AS BIGINT) AS exponent FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders))""")
def float_forms(spark, d):
    """Exponents in either case, signs, INF, -INF, NaN; equality across exponents."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    number = F.concat(F.when(k % 2 == 0, "").otherwise("-"), F.when(F.length(c) > 2, F.substring(c, F.lit(1), F.length(c) - 2)).otherwise("0"), F.lit("."), F.lpad(F.when(F.length(c) > 2, F.substring(c, F.length(c) - 1, F.lit(2))).otherwise(c), 2, "0"), F.when(k % 3 == 0, "e").otherwise("E"), (k % 11 - 5).cast("string"))
    text = F.when(k % 7 == 0, "INF").when(k % 7 == 1, "-INF").when(k % 7 == 2, "NaN").otherwise(number)
    shifted = F.when(k % 7 < 3, text).otherwise(F.regexp_replace(F.regexp_replace(number, "[.]", ""), "[eE].*$", F.lit("")))
    rows = table(spark, d, "orders").select(k.alias("key"), N.float_parts(text).alias("p"), N.float_parts(F.when(k % 7 < 3, text).otherwise(F.concat(shifted, F.lit("00E"), (k % 11 - 9).cast("string")))).alias("q"), N.float_parts(F.when(k % 7 < 3, text).otherwise(F.concat(shifted, F.lit("1E0")))).alias("r"))
    p = F.col("p")
    return rows.select("key", "p.mantissa", long("p.exponent").alias("exponent"), N.float_bits(p).alias("bits"), N.float_text(p).alias("canonical"), F.when(F.col("p.exponent") > -16384, N.float_double(p)).alias("number"), N.float_equal(p, F.col("q")).alias("same"), N.float_equal(p, F.col("r")).alias("unlike"))


ZONE_BITS = f"CASE o_orderkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' || {O.nbit('896', 11)} ELSE '1' || {O.nbit('896 - (5 * 64 + 30)', 11)} END"
ZONE_TEXT = "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '-05:30' END"
KIND_FORMS = {"gYear": "%Y", "gYearMonth": "%Y-%m", "gMonth": "--%m", "gMonthDay": "--%m-%d", "gDay": "---%d", "date": "%Y-%m-%d"}
KIND_BITS = {
    "gYear": O.sint("year(o_orderdate) - 2000"), "gYearMonth": f"{O.sint('year(o_orderdate) - 2000')} || {O.nbit('month(o_orderdate) * 32', 9)}", "gMonth": O.nbit("month(o_orderdate) * 32", 9), "gMonthDay": O.nbit("month(o_orderdate) * 32 + day(o_orderdate)", 9),
    "gDay": O.nbit("day(o_orderdate)", 9), "date": f"{O.sint('year(o_orderdate) - 2000')} || {O.nbit('month(o_orderdate) * 32 + day(o_orderdate)', 9)}",
}


@query(" UNION ALL ".join(f"SELECT o_orderkey AS key, '{k}' AS kind, strftime(o_orderdate, '{f}') || {ZONE_TEXT} AS text, {KIND_BITS[k]} || {ZONE_BITS} AS bits FROM orders" for k, f in KIND_FORMS.items()))
def datetime_kinds(spark, d):
    """Wire form and canonical text of the kinds without a clock, in three zones."""
    zone = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "Z").otherwise("-05:30")
    patterns = {"gYear": "yyyy", "gYearMonth": "yyyy-MM", "gMonth": "--MM", "gMonthDay": "--MM-dd", "gDay": "---dd", "date": "yyyy-MM-dd"}
    rows = table(spark, d, "orders")
    made = [F.struct(F.lit(kind).alias("kind"), M.parts(F.concat(F.date_format("o_orderdate", p.replace("--", "'--'").replace("'--'-", "'---'")), zone), kind).alias("p")) for kind, p in patterns.items()]
    out = None
    for kind, m in zip(patterns, made, strict=True):
        part = rows.select(F.col("o_orderkey").alias("key"), m.alias("m")).select("key", "m.kind", M.text(F.col("m.p"), kind).alias("text"), M.wire(F.col("m.p"), kind).alias("bits"))
        out = part if out is None else out.unionByName(part)
    return out


MICROS = "date_part('microseconds', ts) % 1000000"
FRACTION = f"CASE WHEN {MICROS} = 0 THEN '0' ELSE '1' || " + O.uint(f"CAST(reverse(rtrim(lpad(CAST({MICROS} AS VARCHAR), 6, '0'), '0')) AS BIGINT)") + " END"


@query(f"SELECT event_id AS key, {O.nbit('(hour(ts) * 64 + minute(ts)) * 64 + second(ts)', 17)} || {FRACTION} || '1' || {O.nbit('896 + 2 * 64', 11)} AS bits, strftime(ts, '%H:%M:%S') || CASE WHEN {MICROS} = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({MICROS} AS VARCHAR), 6, '0'), '0') END || '+02:00' AS text FROM events")
def datetime_time(spark, d):
    t = F.concat(F.date_format("ts", "HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("key"), M.parts(t, "time").alias("p"))
    return rows.select("key", M.wire(F.col("p"), "time").alias("bits"), M.text(F.col("p"), "time").alias("text"))


NEXT = "o_orderdate + INTERVAL 1 DAY"


@query(f"""SELECT o_orderkey AS key, strftime({NEXT}, '%Y-%m-%dT00:00:00Z') AS text, {O.sint(f'year({NEXT}) - 2000')} || {O.nbit(f'month({NEXT}) * 32 + day({NEXT})', 9)} || {O.nbit('0', 17)} || '0' || '1' || {O.nbit('896', 11)} AS bits,
true AS same, false AS other, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%dZ') AS utc, strftime(o_orderdate, '%Y-%m') || 'Z' AS month FROM orders""")
def datetime_rollover(spark, d):
    """Hour 24 is hour 0 of the next day; equality across zones and days; dates and months in UTC."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    late, noon = F.concat(day, F.lit("T24:00:00Z")), F.concat(day, F.lit("T10:00:00-14:00"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), M.parts(late, "dateTime").alias("p"), M.equal(late, noon, "dateTime").alias("same"), M.equal(late, F.concat(day, F.lit("T00:00:00Z")), "dateTime").alias("other"), M.to_utc(F.concat(day, F.lit("+14:00")), "date").alias("utc"), M.to_utc(F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-05:00")), "gYearMonth").alias("month"))
    return rows.select("key", M.text(M.rolled(F.col("p"), "dateTime"), "dateTime").alias("text"), M.wire(F.col("p"), "dateTime").alias("bits"), "same", "other", "utc", "month")


@query("SELECT event_id AS key, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microseconds', ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(date_part('microseconds', ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z' AS text, epoch_us(ts) AS micros FROM events")
def datetime_native(spark, d):
    """Times from Spark's own and back."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("key"), M.from_timestamp(F.col("ts")).alias("p"))
    return rows.select("key", M.text(F.col("p"), "dateTime").alias("text"), F.unix_micros(M.to_timestamp(F.col("p"))).alias("micros"))


@query("""SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment ELSE 'p' || (c_custkey % 3) || ':' || c_mktsegment END AS text, true AS same, c_mktsegment = 'BUILDING' AS building,
CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'xml' WHEN 2 THEN 'xsi' ELSE 'ns' || (c_custkey % 5) END AS prefix, CAST(row_number() OVER (ORDER BY c_mktsegment, 'urn:' || (c_custkey % 5), c_custkey) AS BIGINT) AS place FROM customer""")
def qname_values(spark, d):
    """Joined names, equality without prefixes, default prefixes, order by local name and namespace."""
    from pyspark.sql import Window

    k, local = F.col("c_custkey"), F.col("c_mktsegment")
    prefix, ns = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("p"), k % 3)), F.concat(F.lit("urn:"), k % 5)
    rows = table(spark, d, "customer").select(k.alias("key"), Q.qname_text(prefix, local).alias("text"), local.alias("local"), ns.alias("ns"), Q.default_prefix(k % 5).alias("prefix"))
    q = Q.qname(F.col("text"))
    rows = rows.select("key", "text", Q.qname_equal(F.col("ns"), q["local"], F.col("ns"), F.col("local")).alias("same"), Q.qname_equal(F.col("ns"), F.col("local"), F.col("ns"), F.lit("BUILDING")).alias("building"), "prefix", Q.qname_order(F.col("ns"), F.col("local")).alias("o"))
    # one order over all names: the query's own, of a small table
    return rows.withColumn("place", long(F.row_number().over(Window.orderBy("o", "key")))).drop("o")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n, true AS valid, CAST(length(text) AS BIGINT) AS counted, md5(reverse(text)) AS reversed, text = text AS same, text IS NOT DISTINCT FROM lang AS other FROM documents")
def text_values(spark, d):
    """Code points of whole texts, counted in their bytes, valid, and in reverse; equality of strings."""
    x = F.col("text")
    valid = F.forall(F.transform(V.chars(F.regexp_replace(x, "[ -~]+", "")), F.ascii), Q.is_code_point)
    return table(spark, d, "documents").select("doc_id", long(F.char_length(x)).alias("n"), valid.alias("valid"), Q.code_point_count(x).alias("counted"), F.md5(F.reverse(x)).alias("reversed"), Q.text_equal(x, x).alias("same"), Q.text_equal(x, F.col("lang")).alias("other"))


@query("""SELECT p_partkey AS key, p_partkey % 3 <> 0 AS valid, CAST(3 AS BIGINT) AS n, p_size || ' ' || (CASE p_partkey % 3 WHEN 0 THEN 'x' ELSE '7' END) || ' ' || p_partkey AS text, p_partkey % 3 <> 0 AS equal, false AS other FROM part""")
def list_values(spark, d):
    """Lists of integers: valid if all items are, equal as values."""
    k, middle = F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise("7")
    one = F.concat_ws("\n ", F.col("p_size").cast("string"), middle, k.cast("string"))
    two = F.concat_ws(" ", F.concat(F.lit("+0"), F.col("p_size").cast("string")), F.concat(F.lit("00"), middle), k.cast("string"))
    tokens, same = V.list_tokens(one), V.list_valid(one, V.parsed_integer) & V.list_equal(one, two, V.parsed_integer)
    return table(spark, d, "part").select(k.alias("key"), V.list_valid(one, V.parsed_integer).alias("valid"), long(F.size(tokens)).alias("n"), F.array_join(tokens, " ").alias("text"), same.alias("equal"), V.list_equal(one, F.lit("1"), V.parsed_integer).alias("other"))


SETS = {
    "base64": ("to_base64(encode(c_name))", lambda: F.base64(F.encode("c_name", "UTF-8"))), "boolean": ("CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' ELSE '0' END", lambda: F.element_at(F.array(*map(F.lit, ("true", "false", "1", "0"))), (F.col("c_custkey") % 4 + 1).cast("int"))),
    "datetime": ("'2020-01-02T03:04:' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || '.5Z'", lambda: F.concat(F.lit("2020-01-02T03:04:"), F.lpad((F.col("c_custkey") % 60).cast("string"), 2, "0"), F.lit(".5Z"))),
    "double": ("'-' || c_custkey || '.5E' || c_nationkey", lambda: F.concat(F.lit("-"), F.col("c_custkey"), F.lit(".5E"), F.col("c_nationkey"))), "hex": ("lower(hex(encode(c_name)))", lambda: F.lower(F.hex(F.encode("c_name", "UTF-8")))), "integer": ("'+' || c_custkey", lambda: F.concat(F.lit("+"), F.col("c_custkey"))),
    "string": ("c_mktsegment", lambda: F.col("c_mktsegment")),
}
OWN_SET = "zaCERUI"


@query(" UNION ALL ".join([*(f"SELECT c_custkey AS key, '{n}' AS charset, {O.uint(f'length({sql}) + 2')} || {O.charset(sql, V.CHARSETS[n])} AS bits FROM customer" for n, (sql, _) in SETS.items()), f"SELECT c_custkey AS key, 'own' AS charset, {O.uint('length(c_mktsegment) + 2')} || {O.charset('c_mktsegment', 'CEIRUaz')} AS bits FROM customer"]))
def charset_sets(spark, d):
    """Each restricted set, and one of one's own, which is sorted by code point."""
    texts = [F.struct(F.lit(n).alias("charset"), V.charset_string(make(), V.CHARSETS[n]).alias("bits")) for n, (_, make) in SETS.items()]
    texts.append(F.struct(F.lit("own").alias("charset"), V.charset_string(F.col("c_mktsegment"), V.custom_charset(OWN_SET)).alias("bits")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.array(*texts)).alias("t")).select("key", "t.*")
