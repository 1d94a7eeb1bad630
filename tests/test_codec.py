"""Golden bits by the wire rules, round trips, and documents that must be refused."""

import datetime as dt
import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from wirespark.sources import codec as C
from wirespark.sources import exi


def bits(write, byte_aligned=False):
    out = C.BitWriter(byte_aligned)
    write(out)
    n = 8 * len(out._bytes) + out._n
    data = out.done()
    return bin(int.from_bytes(b"\1" + data, "big"))[3:][:n]


def typed(kind, value, meta=None):
    return bits(lambda o: C.write_value(o, C.Strings(), "x", kind, value, meta or {}))


@pytest.mark.parametrize("n, want", [(0, "00000000"), (127, "01111111"), (128, "1000000000000001"), (300, "1010110000000010"), (16384, "100000001000000000000001"), (2**32, "1000000010000000100000001000000000010000")])
def test_unsigned(n, want):
    assert bits(lambda o: o.unsigned(n)) == want


@pytest.mark.parametrize(
    "kind, value, want",
    [
        (T.LongType(), 0, "000000000"), (T.LongType(), -1, "100000000"), (T.LongType(), -128, "101111111"), (T.LongType(), -129, "11000000000000001"),
        (T.BinaryType(), b"\x00\xff", "000000100000000011111111"), (T.DecimalType(10, 2), decimal.Decimal("-1.30"), "10000000100000011"), (T.DecimalType(10, 3), decimal.Decimal("12.034"), "0000011001010111000000011"),
        (T.DoubleType(), 12.5, "001111101100000000"), (T.DoubleType(), 12300.0, "001111011000000010"), (T.DoubleType(), float("inf"), "000000001" + "11111111101111111"), (T.DoubleType(), float("nan"), "000000000" + "11111111101111111"),
        (T.DateType(), dt.date(1999, 1, 2), "100000000" + "000100010" + "0"),
        (T.TimestampType(), dt.datetime(2024, 12, 25, 12, 34, 56, 120000), "000011000" + "110011001" + "01100100010111000" + "100010101" + "1" + "01110000000"),
    ],
)
def test_typed_values(kind, value, want):
    assert typed(kind, value) == want


def test_bounds_and_members():
    assert typed(T.LongType(), 5, {"min": 0, "max": 7}) == "101" and typed(T.LongType(), -1, {"min": -128, "max": 127}) == "01111111"
    assert [typed(T.StringType(), m, {"enum": ["a", "b", "c"]}) for m in "abc"] == ["00", "01", "10"]
    with pytest.raises(C.Invalid):
        typed(T.LongType(), 8, {"min": 0, "max": 7})
    with pytest.raises(C.Invalid):
        typed(T.StringType(), "d", {"enum": ["a"]})


@pytest.mark.parametrize("n, want", list(zip((0, 1, 2, 3, 4, 5, 8, 9, 256, 257, 32768, 32769), (0, 0, 1, 2, 2, 3, 3, 4, 8, 9, 15, 16), strict=True)))
def test_width(n, want):
    assert C.width(n) == want


def test_headers():
    assert bits(lambda o: C.write_header(o, C.Options())) == "10000000"
    assert bits(lambda o: C.write_header(o, C.Options(cookie=True))) == f"{int.from_bytes(b'$EXI', 'big'):032b}10000000"
    assert bits(lambda o: C.write_header(o, C.Options(strict=True, with_options=True))) == "10100000" + "010"
    assert bits(lambda o: C.write_header(o, C.Options(fragment=True, with_options=True))) == "10100000" + "0010111"
    for o in (C.Options(with_options=True, comments=True, capacity=7, max_length=9), C.Options(with_options=True, cookie=True, byte_aligned=True, pis=True, strict=True)):
        out = C.BitWriter()
        C.write_header(out, o)
        assert C.read_header(out.done(), C.Options())[1] == o


@pytest.mark.parametrize("data", [b"$EXJ\x80", b"\x40", b"\x90", b"\x81", b"\x8f\x00", b""])
def test_bad_headers(data):
    with pytest.raises(C.Invalid):
        C.read_header(data, C.Options())


def test_string_table():
    def codes(values, **limits):
        s = C.Strings(**limits)
        return [bits(lambda o, c=c, v=v: s.write(o, c, v)) for c, v in values]

    hits = codes([("x", "foo"), ("y", "foo"), ("x", "foo"), ("x", "bar"), ("y", "bar"), ("x", ""), ("x", "")])
    assert hits[1] == "00000001" and hits[2] == "00000000" and hits[4] == "00000001" + "1" and hits[5] == hits[6] == "00000010"
    assert codes([("x", "foo")], shared=("foo",)) == ["00000001"]
    long = codes([("x", "abcd"), ("x", "abcd")], max_length=3)
    assert long[0] == long[1]
    ring = codes([("x", "a"), ("x", "b"), ("x", "c"), ("x", "a")], capacity=2)
    assert all(r.startswith("00000011") for r in ring)


def test_learned_grammar():
    e = lambda n: [("SE", ("", n), None), ("EE", None, None)]
    doc = [("SE", ("", "r"), None), *e("a"), *e("b"), *e("a"), ("EE", None, None)]
    data = C.SchemaLess().encode(doc)
    assert C.SchemaLess().decode(data) == doc
    again = C.SchemaLess().encode([*doc[:-1], *e("a"), *e("a"), ("EE", None, None)])
    assert len(again) <= len(data) + 1  # a learned element is a few bits


XML = '<p z="1" a="2" xmlns="urn:x" xmlns:q="urn:y" q:k="3" xml:lang="en">x<b>y &lt; é𝔘</b> <i>z</i><!--c--><?t d?><e> </e></p>'


@pytest.mark.parametrize("o", [C.Options(), C.Options(comments=True), C.Options(comments=True, pis=True, with_options=True, cookie=True), C.Options(byte_aligned=True), C.Options(capacity=1), C.Options(max_length=0, local=False)])
def test_xml(o):
    events = exi.parse_xml(XML, o)
    assert [n[1] for k, n, _ in events if k == "AT"] == ["a", "k", "lang", "z"]
    assert [v for k, _, v in events if k == "CH"] == ["x", "y < é𝔘", "z", " "]
    assert C.SchemaLess(o).decode(C.SchemaLess(o).encode(events)) == events
    assert exi.parse_xml(exi.format_xml(events), o) == events
    with pytest.raises(C.Invalid):
        exi.parse_xml("<a><b></a>")


names = st.sampled_from(["a", "b", "é", "long-name"])


@st.composite
def elements(draw, depth=0):
    name = ("", draw(names)) if draw(st.booleans()) else ("urn:z", draw(names))
    out = [("SE", name, None)]
    out += [("AT", ("", n), draw(st.text(max_size=6))) for n in sorted(draw(st.sets(names, max_size=2)))]
    for _ in range(draw(st.integers(0, 3 if depth < 3 else 0))):
        out += [("CH", None, draw(st.text(max_size=8)))] if draw(st.booleans()) else draw(elements(depth + 1))
    return [*out, ("EE", None, None)]


@settings(max_examples=60, deadline=None)
@given(elements(), st.sampled_from([C.Options(), C.Options(byte_aligned=True), C.Options(capacity=2, max_length=4), C.Options(fragment=True)]))
def test_any_document(doc, o):
    docs = doc + doc if o.fragment else doc
    assert C.SchemaLess(o).decode(C.SchemaLess(o).encode(docs)) == docs


def field(name, kind, nullable=True):
    return T.StructField(name, kind, nullable)


ORDER = T.StructType(
    [
        field("_id", T.IntegerType(), False), field("customer", T.StringType(), False), field("placed", T.TimestampNTZType()), field("total", T.DecimalType(18, 2)), field("express", T.BooleanType()), field("tags", T.ArrayType(T.StringType())),
        field("lines", T.ArrayType(T.StructType([field("sku", T.StringType()), field("qty", T.IntegerType())]))), field("x", T.DoubleType()), field("raw", T.BinaryType()), field("day", T.DateType()),
    ]
)
rows = st.fixed_dictionaries(
    {
        "_id": st.integers(-(2**31), 2**31 - 1), "customer": st.text(max_size=9), "placed": st.none() | st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2200, 1, 1)), "total": st.none() | st.decimals(-(10**12), 10**12, places=2),
        "express": st.none() | st.booleans(), "tags": st.lists(st.sampled_from(["t", "u", ""]), max_size=3), "lines": st.lists(st.fixed_dictionaries({"sku": st.none() | st.text(max_size=3), "qty": st.none() | st.integers(0, 9)}), max_size=3),
        "x": st.none() | st.floats(allow_nan=False), "raw": st.none() | st.binary(max_size=5), "day": st.none() | st.dates(dt.date(1000, 1, 1)),
    }
)


@settings(max_examples=80, deadline=None)
@given(rows, st.booleans())
def test_any_row(row, byte_aligned):
    s, o = C.Strict(ORDER, "order"), C.Options(strict=True, byte_aligned=byte_aligned, with_options=byte_aligned)
    assert s.decode(s.encode(row, o), o) == row


def test_missing_and_truncated():
    s = C.Strict(ORDER, "order")
    with pytest.raises(C.Invalid):
        s.encode({"_id": 1})
    data = s.encode({"_id": 1, "customer": "someone"})
    with pytest.raises(C.Invalid):
        s.decode(data[:4])


def test_lists_charsets_and_lexical_values():
    s = C.Strict(T.StructType([T.StructField("n", T.ArrayType(T.LongType()), True, {"list": True}), T.StructField("h", T.StringType(), True, {"charset": C.CHARSETS["hex"]}), T.StructField("d", T.DecimalType(9, 2), True, {"lexical": True}), T.StructField("b", T.BooleanType(), True, {"lexical": True}), T.StructField("t", T.DateType(), True, {"lexical": True})]), "r")
    row = {"n": [1, -2], "h": "F0z", "d": decimal.Decimal("-1.50"), "b": True, "t": dt.date(2020, 2, 29)}
    assert s.decode(s.encode(row)) == row
    assert s.decode(s.encode({})) == dict.fromkeys(row)
    out = C.BitWriter()
    C.Strings().write(out, "x", "F0", C.CHARSETS["hex"])
    assert out.done() == int("00000100" + "10011" + "00100" + "000000", 2).to_bytes(3, "big")
    assert (C.value_of(T.DoubleType(), "-INF"), C.value_of(T.BooleanType(), " 1 ")) == (float("-inf"), True)
    for kind, text in ((T.LongType(), "abc"), (T.BooleanType(), "yes"), (T.DateType(), "2020-13-01")):
        with pytest.raises(C.Invalid):
            C.value_of(kind, text)


SC_DOC = [("SE", ("", "r"), None), ("SE", ("", "a"), None), ("SC", None, None), ("AT", ("", "k"), "v"), ("CH", None, "long text"), ("SE", ("", "b"), None), ("EE", None, None), ("EE", None, None), ("SE", ("", "a"), None), ("CH", None, "v"), ("EE", None, None), ("EE", None, None)]


@pytest.mark.parametrize("byte_aligned", [False, True])
def test_self_contained(byte_aligned):
    o = C.Options(self_contained=True, byte_aligned=byte_aligned, with_options=byte_aligned)
    data = C.SchemaLess(o).encode(SC_DOC)
    assert C.SchemaLess(o).decode(data) == SC_DOC
    assert C.SchemaLess(o).decode(data, skip=True) == [*SC_DOC[:3], *SC_DOC[7:]]


def test_doctype_references_and_caps():
    doc = [("DT", ("", "r"), "pub\0sys\0<!ENTITY x 'y'>"), ("CM", None, "c"), ("SE", ("", "r"), None), ("CH", None, "t"), ("ER", ("", "x"), None), ("SE", ("", "r"), None), ("EE", None, None), ("EE", None, None), ("CM", None, "d")]
    for o in (C.Options(dtd=True, comments=True), C.Options(dtd=True, comments=True, with_options=True), C.Options(dtd=True, comments=True, max_productions=1)):
        assert C.SchemaLess(o).decode(C.SchemaLess(o).encode(doc)) == doc
    assert [e[0] for e in C.SchemaLess().decode(C.SchemaLess().encode(doc))] == ["SE", "CH", "SE", "EE", "EE"]
