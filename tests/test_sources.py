import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirespark.functions import bits as B
from wirespark.functions import values as V
from wirespark.operators import dictionary as D
from wirespark.operators import events as E
from wirespark.sources import exi
from wirespark.sources.codec import Options
from wirespark.streaming import documents as S


def key(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/exi"


def test_data_source_round_trip(spark, data, path):
    exi.register(spark)
    rows = spark.read.parquet(f"{data}/customer.parquet").withColumn("tags", F.split("c_name", "#")).repartition(3)
    at = path
    rows.write.format("exi").option("root", "customer").mode("append").save(at)
    back = spark.read.format("exi").schema(rows.schema).option("root", "customer").load(at)
    assert key(back) == key(rows)
    with pytest.raises(Exception, match="unknown option"):
        spark.read.format("exi").schema(rows.schema).option("rot", "x").load(at).count()


def test_appends_overwrites_and_failures(spark, path, tmp_path):
    exi.register(spark)
    rows = spark.range(5).selectExpr("id", "if(id = 9, null, 'x') as t").repartition(2)
    write = lambda df, mode: df.write.format("exi").option("root", "r").mode(mode).save(path)
    read = lambda: sorted(r["id"] for r in spark.read.format("exi").schema(rows.schema).option("root", "r").load(path).collect())
    write(rows, "append")
    write(rows.where("id = 1"), "append")
    assert read() == [0, 1, 1, 2, 3, 4]
    write(rows.where("id = 3"), "overwrite")
    assert read() == [3]
    broken = spark.range(6).selectExpr("id", "if(id = 5, array('a', null), array('b')) as t").repartition(3)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="null"):
            write(broken, mode)
        assert read() == [3]
    assert not [p for p in (tmp_path / "exi").iterdir() if p.name.startswith("_writing")]


def test_one_document_a_file(spark, path, tmp_path):
    """Documents that others wrote, and for others: a file is one document."""
    exi.register(spark)
    rows = spark.range(3).selectExpr("id", "concat('n', id) as name")
    rows.write.format("exi").options(root="r", layout="single", cookie="true").mode("append").save(path)
    files = sorted((tmp_path / "exi").iterdir())
    assert len(files) == 3 and all(f.suffix == ".exi" and f.read_bytes().startswith(b"$EXI") for f in files)
    plain = exi.encode_rows(spark.range(7, 8).selectExpr("id", "'other' as name"), "r").collect()[0]["content"]
    (tmp_path / "exi" / "a.exi").write_bytes(bytes(plain))
    back = spark.read.format("exi").schema(rows.schema).option("root", "r").load(path)
    assert sorted((r["id"], r["name"]) for r in back.collect()) == [(0, "n0"), (1, "n1"), (2, "n2"), (7, "other")]
    bare = f"{path}-bare"
    rows.write.format("exi").options(root="r", body_only="true", strict="false", byte_aligned="true").mode("append").save(bare)
    back = spark.read.format("exi").schema(rows.schema).options(root="r", body_only="true", strict="false", byte_aligned="true").load(bare)
    assert key(back) == key(rows)


def test_permissive_mode_says_why(spark):
    df = spark.createDataFrame([(1, b"$EXX"), (2, b"\x80"), (3, None)], "id int, content binary")
    got = {r["id"]: r for r in exi.decode_rows(df, "r", T.StructType.fromDDL("a long"), mode="permissive", reason="why").collect()}
    assert all(r["a"] is None for r in got.values())
    assert "cookie" in got[1]["why"] and "early" in got[2]["why"] and got[3]["why"] is None


def test_documents_by_schema_id(spark):
    xml = spark.createDataFrame([(i, f"<{'a' if i % 2 else 'b'}><v>{i}</v></{'a' if i % 2 else 'b'}>") for i in range(4)], "id int, xml string")
    schemas = {"urn:a": ("a", T.StructType.fromDDL("v long")), "urn:b": ("b", T.StructType.fromDDL("v string"))}
    parts = [exi.encode_xml(xml.where(f"id % 2 = {k}"), options=Options(schema_id=n, with_options=True), schema=exi.Schema.of(schemas[n][1], schemas[n][0])) for k, n in ((1, "urn:a"), (0, "urn:b"))]
    got = sorted((r["id"], r["schema_id"], (r["urn:a"] or r["urn:b"])["v"]) for r in exi.by_schema_id(parts[0].unionByName(parts[1]), schemas).collect())
    assert got == [(0, "urn:b", "0"), (1, "urn:a", 1), (2, "urn:b", "2"), (3, "urn:a", 3)]
    with pytest.raises(Exception, match="no schema"):
        exi.by_schema_id(parts[0], {"urn:b": schemas["urn:b"]}).collect()


def test_xml_columns(spark):
    df = spark.createDataFrame([(1, "<a><b x='1'>t</b><b/></a>"), (2, None), (3, "<broken")], "id long, xml string")
    back = exi.decode_xml(exi.encode_xml(df, mode="permissive")).collect()
    assert [(r["id"], r["xml"]) for r in back] == [(1, '<a><b x="1">t</b><b/></a>'), (2, None), (3, None)]
    with pytest.raises(Exception, match="Invalid"):
        exi.encode_xml(df).collect()


def test_events_match_between_paths(spark, data):
    """The event table of rows, and the events that their documents decode to, are the same."""
    nation = spark.read.parquet(f"{data}/nation.parquet")
    table = E.from_rows(nation, F.col("n_nationkey"), "nation", ["n_name", "n_regionkey"])
    inner = table.where("event not in ('SD', 'ED')")
    packed = inner.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", F.when(F.col("event") == "SE", "").alias("ns"), F.when(F.col("event") == "SE", F.col("local")).alias("local"), "value"))).alias("e"))
    docs = exi.encode_events(packed.select("doc_id", F.transform("e", lambda e: F.struct(e["event"].alias("event"), e["ns"].alias("ns"), e["local"].alias("local"), e["value"].alias("value"), F.lit(None).cast("string").alias("prefix"))).alias("events")))
    back = exi.event_rows(exi.decode_events(docs), "doc_id")
    assert key(back.select("doc_id", (F.col("seq") + 1).cast("long").alias("seq"), "event", "value")) == key(inner.select("doc_id", "seq", "event", "value"))


def test_bits_of_expressions_are_the_codec_s(spark, data):
    region = spark.read.parquet(f"{data}/region.parquet").select(F.col("r_regionkey").cast("long").alias("key"), "r_name")
    # optional fields: the code of the first of three, of the first of two, of the only one
    bits = F.concat(F.lit("10000000"), F.lit("0"), F.lit("00"), B.integer(F.col("key")), F.lit("0"), B.unsigned(F.char_length("r_name") + 2), V.characters(F.col("r_name")))
    assert sorted(r[0].hex() for r in exi.encode_rows(region, "region").collect()) == sorted(bytes(r[0]).hex() for r in region.select(B.pack(bits)).collect())


def test_bit_expressions(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**40 + 5, 2**62]
    df = spark.createDataFrame([(n, k) for n in values for k in (0, 3, 8)], "n long, k int")
    bits = F.concat(F.repeat(F.lit("1"), F.col("k")), B.integer(-F.col("n")), B.unsigned(F.col("n")), F.lit("01"))
    rows = df.withColumn("b", B.unpack(B.pack(bits))).withColumn("i", B.read_integer(F.col("b"), F.col("k"))).withColumn("u", B.read_unsigned(F.col("b"), F.col("i.next")))
    for r in rows.collect():
        assert (-r["i"]["value"], r["u"]["value"]) == (r["n"], r["n"])
        assert r["b"][r["u"]["next"] : r["u"]["next"] + 2] == "01"
    one = spark.createDataFrame([(bytes(range(1, 40)), b"")], "d binary, e binary").select(B.unpack(F.col("d")).alias("b"), B.unpack(F.col("e")).alias("e"))
    got = one.select("b", "e", B.pack(F.col("b")).alias("d"), B.read_bytes(F.col("b"), F.lit(4), 2).alias("two"), B.read(F.col("b"), F.lit(0), 0).alias("none"), B.read(F.col("b"), F.lit(310), 9).alias("over"), B.look_ahead(F.col("b"), F.lit(9)).alias("ahead")).collect()[0]
    assert bytes(got["d"]) == bytes(range(1, 40)) and got["e"] == "" and bytes(got["two"]) == b"\x10\x20" and (got["none"], got["over"], got["ahead"]) == (None, None, 3)


def test_time_expressions(spark):
    """Against the codec's own, which is plain Python."""
    from wirespark.functions import times as M
    from wirespark.sources import wire

    texts = {
        "dateTime": ["2000-02-29T23:59:60.120-14:00", "1999-12-31T24:00:00Z", "-0001-01-01T00:00:00", "2100-02-28T24:00:00+13:59", "12345-06-07T08:09:10.000", "2000-01-01", "2000-01-01T25:00:00", "", "x"], "date": ["2001-03-01+14:00", "2000-03-01Z", "1900-12-31-14:00", "2000-1-1"],
        "gYear": ["2020Z", "-2020", "2020-05:00", "20"], "gYearMonth": ["2020-01-05:30", "1999-12"], "gMonth": ["--07", "--12--Z", "--13"], "gMonthDay": ["--02-29+01:00"], "gDay": ["---31Z", "---32"], "time": ["00:00:00.5+02:00", "24:00:00", "9:00:00"],
    }
    for kind, own in texts.items():
        df = spark.createDataFrame([(t,) for t in own], "t string").select("t", M.parts(F.col("t"), kind).alias("p"))
        for r in df.select("t", M.wire(F.col("p"), kind).alias("b"), M.text(M.rolled(F.col("p"), kind), kind).alias("x"), M.text(M.normalised(F.col("p"), kind), kind).alias("u")).collect():
            try:
                p = wire.time_parts(r["t"], kind)
            except wire.Invalid:
                assert (r["b"], r["x"], r["u"]) == (None, None, None), r
                continue
            out = wire.BitWriter()
            wire.write_time(out, p, kind)
            n = 8 * len(out._bytes) + out._n
            assert r["b"] == bin(int.from_bytes(b"\1" + out.done(), "big"))[3:][:n], r
            assert r["x"] == wire.time_text(p, kind), r
            if p["y"] >= 0:
                assert r["u"] == wire.time_text(wire.time_in_utc(p, kind), kind), r


def test_number_expressions(spark):
    from wirespark.functions import numbers as N

    rows = [("1.5E3", 15, 2), (" -0.00 ", 0, 0), ("1e-2", 1, -2), ("INF", 1, -16384), ("-INF", -1, -16384), ("NaN", 0, -16384), (".5", 5, -1), ("5.", 5, 0), ("1e99999", None, None), ("+7", 7, 0), ("1E", None, None), ("", None, None), ("x", None, None), ("0e5", 0, 0)]
    df = spark.createDataFrame(rows, "t string, m long, e int").select("*", N.float_parts(F.col("t")).alias("p"))
    for r in df.collect():
        assert (r["p"]["mantissa"], r["p"]["exponent"]) == (r["m"], r["e"]) if r["p"] else r["m"] is None, r
    big = spark.createDataFrame([("+0099999999999999999999999999999999999999",), ("-5",), ("1234567890123456789012345678901234567890123",), ("1.0",), ("--1",)], "t string").select(N.integer_value(F.col("t")).alias("v")).collect()
    assert [r["v"] and (r["v"]["width"], r["v"]["text"][-3:], r["v"]["value"] is not None) for r in big] == [("big", "999", True), ("32", "-5", True), ("big", "123", False), None, None]


def test_streams(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/region.parquet")
    for i, r in enumerate(exi.encode_rows(rows, "region").collect()):
        (tmp_path / f"{i}.exi").write_bytes(bytes(r["content"]))
    (tmp_path / "bad.exi").write_bytes(b"$EXX")
    q = S.read_rows(spark, str(tmp_path), "region", rows.schema).writeStream.format("memory").queryName("regions").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r["r_name"] for r in spark.table("regions").where("r_name is not null").collect()) == sorted(r["r_name"] for r in rows.collect())


def test_bounded_table_without_bounds_is_the_window_table(spark):
    values = [(d, i, "xyz"[(i * 7 + d) % 3], f"v{(i * i + d) % 5}" if i % 6 else "") for d in range(3) for i in range(40)]
    df = spark.createDataFrame(values, "doc_id long, seq long, ctx string, value string")
    fold = {(r["doc_id"], r["seq"]): r for r in D.bounded_table(df).collect()}
    for r in D.value_table(df).collect():
        f = fold[r["doc_id"], r["seq"]]
        assert f["hit"] == r["hit"]
        if r["hit"] != "miss":
            assert (f["id"], f["size"]) == ((r["local_id"], r["local_size"]) if r["hit"] == "local" else (r["global_id"], r["global_size"]))


def test_text_and_parents(spark):
    df = spark.createDataFrame([(1, 0, "SD", None), (1, 1, "SE", "r"), (1, 2, "SE", "a"), (1, 3, "SE", "b"), (1, 4, "EE", "b"), (1, 5, "EE", "a"), (1, 6, "SE", "c"), (1, 7, "CH", None), (1, 8, "EE", "c"), (1, 9, "EE", "r"), (1, 10, "ED", None)], "doc_id long, seq long, event string, local string").withColumn("value", F.lit(None).cast("string"))
    got = {r["seq"]: (r["depth"], r["parent_seq"]) for r in E.with_depth(df).collect()}
    assert got == {0: (0, None), 1: (1, None), 2: (2, 1), 3: (3, 2), 4: (3, 2), 5: (2, 1), 6: (2, 1), 7: (2, 6), 8: (2, 1), 9: (1, None), 10: (0, None)}


def test_header_expression(spark):
    o = [Options(), Options(cookie=True), Options(with_options=True, strict=True)]
    from wirespark.sources.codec import BitWriter, write_header

    def made(x):
        w = BitWriter()
        write_header(w, x)
        return w.done()

    df = spark.createDataFrame([(i, made(x)) for i, x in enumerate(o)] + [(9, b"$EXJ\x80"), (10, b"\x40")], "i int, content binary")
    got = {r["i"]: r["h"] for r in df.select("i", exi.header(F.col("content")).alias("h")).collect()}
    assert [got[i]["valid"] for i in (0, 1, 2, 9, 10)] == [True, True, True, False, False]
    assert [got[i]["cookie"] for i in (0, 1, 2)] == [False, True, False] and [got[i]["options"] for i in (0, 1, 2)] == [False, False, True]


def test_transitions_are_the_codec_s(spark):
    from wirespark.operators.grammar import transitions
    from wirespark.sources.codec import BitReader, Strict

    schema = T.StructType([T.StructField("_k", T.StringType()), T.StructField("a", T.ArrayType(T.StructType([]))), T.StructField("b", T.StructType([]), False), T.StructField("c", T.StructType([]))])
    rows = {(r["state"], r["code"]): r for r in transitions(spark, schema, "r").collect() if r["grammar"] == "r"}
    for row in ({"a": [{}, {}], "b": {}, "c": {}}, {"b": {}}, {"a": [{}], "b": {}}):
        data = Strict(schema, "r").encode(row)
        source, state, seen = BitReader(data, 9), 0, []
        while state is not None:
            size = {r["width"] for (s, _), r in rows.items() if s == state}
            assert len(size) == 1
            r = rows[state, source.nbit(size.pop())]
            seen.append(r["local"])
            state = r["next"]
        assert seen == [*["a"] * len(row.get("a", [])), "b", *["c"] * ("c" in row), None]
