"""Schema-informed documents: golden bits, undeclared content, nil, named types, wildcards, prefixes, limits, mapping."""

import datetime as dt
import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tests.test_codec import ORDER, rows
from wirespark.operators import representation as R
from wirespark.sources import codec as C
from wirespark.sources import exi
from wirespark.sources import machine as M
from wirespark.sources import rows as W
from wirespark.sources import wire
from wirespark.sources.schema import Schema

SE, AT, CH, EE = (lambda n, ns="": ("SE", (ns, n), None)), (lambda n, v, ns="": ("AT", (ns, n), v)), (lambda v: ("CH", None, v)), ("EE", None, None)


def field(name, kind, nullable=True, **meta):
    return T.StructField(name, kind, nullable, meta)


def bits(schema, o, events):
    out = C.BitWriter(o.byte_aligned)
    m = M.Machine(schema, o)
    m.begin()
    m.write(out, events)
    n = 8 * len(out._bytes) + out._n
    return bin(int.from_bytes(b"\1" + out.done(), "big"))[3:][:n]


def back(schema, o, events):
    return M.Machine(schema, o).decode(M.Machine(schema, o).encode(events))


PLAIN = T.StructType([field("_k", T.StringType()), field("n", T.LongType(), False), field("s", T.StringType())])


@settings(max_examples=60, deadline=None)
@given(rows, st.booleans())
def test_strict_documents_are_those_of_the_short_way(row, byte_aligned):
    o = C.Options(strict=True, byte_aligned=byte_aligned, with_options=byte_aligned)
    whole, short = W.Rows(ORDER, "order"), C.Strict(ORDER, "order")
    data = short.encode(row, o)
    assert whole.encode(row, o) == data
    assert whole.decode(data, o) == row
    loose = C.Options(byte_aligned=byte_aligned, lexical=False)
    assert whole.decode(whole.encode(row, loose), loose) == row


def test_codes_of_a_start_tag():
    """First level: AT(k) 0, SE(n) 1 and the escape, in 2 bits; second: EE, xsi:type, xsi:nil, AT, AT-untyped, SE, CH in 3."""
    s, o = Schema.of(PLAIN, "r"), C.Options()
    assert bits(s, o, [SE("r"), SE("n"), CH("1"), EE, EE]).startswith("0" + "01" + "0" + "000000001")
    text = bits(s, o, [SE("r"), CH("x"), EE])
    assert text.startswith("0" + "10" + "110" + "00000011" + "01111000")
    # in the content the escape has EE, SE, CH: the end of an element that lacks its children
    assert text.endswith("1" + "00") and len(text) == 1 + 2 + 3 + 16 + 3


def test_invalid_values_fall_back_to_text():
    s, o = Schema.of(T.StructType([field("_d", T.LongType()), field("n", T.LongType(), False)]), "r"), C.Options()
    doc = [SE("r"), AT("d", "soon"), SE("n"), CH("many"), EE, EE]
    assert back(s, o, doc) == doc
    # escape 2 of 2 bits, AT-untyped 4 of 3 bits, then the attribute's place among those declared
    assert bits(s, o, doc).startswith("0" + "10" + "100" + "0" + "00000110")
    with pytest.raises(C.Invalid):
        M.Machine(s, C.Options(strict=True)).encode(doc)


def test_undeclared_content_learns_beside_the_schema():
    s, o = Schema.of(PLAIN, "r"), C.Options(comments=True)
    doc = [SE("r"), AT("extra", "1"), AT("k", "v"), SE("new"), AT("a", "b"), CH("t"), SE("new"), EE, EE, ("CM", None, "c"), SE("n"), CH("7"), EE, SE("other", "urn:o"), EE, CH("tail"), EE]
    assert back(s, o, doc) == doc
    twice = [*doc[:-1], *doc[3:9], EE]
    assert len(M.Machine(s, o).encode(twice)) < len(M.Machine(s, o).encode(doc)) + 10


NIL, TYPE = (C.XSI_NS, "nil"), (C.XSI_NS, "type")


def test_nil():
    schema = T.StructType([field("a", T.LongType(), False, nillable=True), field("b", T.ArrayType(T.StringType()), False, nillable=True)])
    for o in (C.Options(strict=True), C.Options(), C.Options(byte_aligned=True)):
        r = W.Rows(schema, "r")
        for row in ({"a": None, "b": ["x", None, ""]}, {"a": 5, "b": []}):
            assert r.decode(r.encode(row, o), o) == row
    s = Schema.of(schema, "r")
    # strict: typed text 0 and the escape 1, then a bit for true, then the end without a code
    assert bits(s, C.Options(strict=True), [SE("r"), SE("a"), ("AT", NIL, "true"), EE, EE]) == "0" + "1" + "1" + "1"
    quiet = [SE("r"), SE("a"), ("AT", NIL, "false"), CH("1"), EE, EE]
    assert back(s, C.Options(), quiet) == [e for e in quiet if e[1] != NIL]
    assert back(s, C.Options(keep_nil=True), quiet) == quiet
    odd = [SE("r"), SE("a"), ("AT", NIL, "perhaps"), CH("1"), EE, EE]
    assert back(s, C.Options(), odd) == odd


def test_types():
    part = T.StructType([field("_xsi_type", T.StringType()), field("name", T.StringType()), field("size", T.LongType()), field("brand", T.StringType())])
    schema = T.StructType([field("p", T.ArrayType(part), False, types={"Small": ["size"], "Large": ["brand"]})])
    row = {"p": [{"_xsi_type": "Small", "name": "a", "size": 3, "brand": None}, {"_xsi_type": None, "name": "b", "size": None, "brand": None}, {"_xsi_type": "Large", "name": None, "size": None, "brand": "x"}]}
    for o in (C.Options(strict=True), C.Options()):
        r = W.Rows(schema, "r")
        assert r.decode(r.encode(row, o), o) == row
    # a cast to a built-in type where the schema says text
    s = Schema.of(T.StructType([field("v", T.StringType())]), "r")
    doc = [SE("r"), SE("v"), ("AT", TYPE, M.clark((C.XSD_NS, "int"))), CH("41"), EE, EE]
    assert back(s, C.Options(), doc) == doc
    assert "000101001" in bits(s, C.Options(), doc)  # 41 as an integer
    unknown = [SE("r"), ("AT", TYPE, "{urn:x}none"), SE("v"), CH("t"), EE, EE]
    assert back(s, C.Options(), unknown) == unknown
    assert back(None, C.Options(), unknown) == unknown  # without a schema, too, its value is a name


def test_wildcards():
    schema = T.StructType([field("_k", T.StringType()), field("a", T.LongType()), field("rest", T.StringType(), any=["urn:x"]), field("z", T.LongType())])
    f = field("r", schema, False, any_attribute=True)
    s = Schema({("", "r"): f}, {("", "when"): field("when", T.DateType())})
    doc = [SE("r"), AT("k", "1"), AT("q", "2", "urn:y"), AT("when", "2020-02-03"), SE("a"), CH("1"), EE, SE("any", "urn:x"), SE("b"), EE, EE, SE("more", "urn:x"), EE, SE("z"), CH("2"), EE, EE]
    for o in (C.Options(), C.Options(strict=True)):
        assert back(s, o, doc) == doc
    wrong = [e if e[1] != ("", "when") else AT("when", "never") for e in doc]
    assert back(s, C.Options(), wrong) == wrong
    row = W.from_events(f, doc)
    assert row["a"] == 1 and row["z"] == 2 and row["rest"] == '<ns0:any xmlns:ns0="urn:x"><b/></ns0:any><ns0:more xmlns:ns0="urn:x"/>'
    with pytest.raises(C.Invalid):
        M.Machine(s, C.Options(strict=True)).encode([SE("r"), SE("any", "urn:else"), EE, EE])
    anything = T.StructType([field("x", T.StringType(), any=True, mixed=True)])
    r = W.Rows(anything, "r")
    assert r.decode(r.encode({"x": "<p>t</p>"}, C.Options(strict=True)), C.Options(strict=True)) == {"x": "<p>t</p>"}


def test_mixed_content():
    s = Schema({("", "r"): field("r", T.StructType([field("b", T.ArrayType(T.StringType()))]), False, mixed=True)})
    doc = [SE("r"), CH("one "), SE("b"), CH("two"), EE, CH(" three"), SE("b"), CH(""), EE, EE]
    for o in (C.Options(), C.Options(strict=True)):
        assert back(s, o, doc) == doc


XML = '<p:r xmlns:p="urn:p" xmlns="urn:d" a="1" p:b="2"><c xmlns:q="urn:q"><q:e xmlns:p="urn:other" p:k="v"/></c><p:c/></p:r>'


@pytest.mark.parametrize("o", [C.Options(prefixes=True), C.Options(prefixes=True, byte_aligned=True, with_options=True), C.Options(prefixes=True, canonical=True)])
def test_prefixes(o):
    events = exi.parse_xml(XML, o)
    assert [n for k, n, _ in events if k == "NS"] == [("urn:d", ""), ("urn:p", "p"), ("urn:q", "q"), ("urn:other", "p")] if o.canonical else [("urn:p", "p"), ("urn:d", ""), ("urn:q", "q"), ("urn:other", "p")]
    assert back(None, o, events) == events
    assert exi.parse_xml(exi.format_xml(events), o) == events
    plain = C.Options()
    assert exi.parse_xml(exi.format_xml(exi.parse_xml(XML, plain)), plain) == exi.parse_xml(XML, plain)


def test_prefix_ids_take_bits_only_with_a_choice():
    names = M.Names(None)
    used = []
    for prefix in ("a", "b", "a"):
        out = C.BitWriter()
        names.write_declared(out, "urn:x", prefix)
        names.write_prefix(out, "urn:x", prefix)
        used.append((len(out._bytes) * 8 + out._n, names.prefixes["urn:x"][:]))
    assert used == [(0 + 16, ["a"]), (1 + 16 + 1, ["a", "b"]), (2 + 1, ["a", "b"])]


def test_document_types_and_entities():
    xml = """<!DOCTYPE r [<!ENTITY x "a]b"><!-- ] --><!ELEMENT r ANY>]><r>t &x; u<!--c--></r>"""
    o = C.Options(dtd=True, comments=True)
    events = exi.parse_xml(xml, o)
    assert ("ER", ("", "x"), None) in events and events[0] == ("DT", ("", "r"), '\0\0<!ENTITY x "a]b"><!-- ] --><!ELEMENT r ANY>')
    assert exi.parse_xml(exi.format_xml(back(None, o, events)), o) == events
    assert [e for e in exi.parse_xml(xml) if e[0] == "CH"] == [CH("t a]b u")]


def test_space_is_kept_where_it_says_so():
    xml = '<r> <a xml:space="preserve"> <b/> </a> <c> </c></r>'
    assert [v for k, _, v in exi.parse_xml(xml) if k == "CH"] == [" ", " ", " "]
    assert [v for k, _, v in exi.parse_xml(xml.replace("preserve", "default")) if k == "CH"] == [" "]


@pytest.mark.parametrize("kind, text, canonical", [
    ("gYear", "2020Z", None), ("gYear", "-0044", None), ("gYear", "12020+01:00", None), ("gYearMonth", "1999-12-05:30", None), ("date", "2024-02-29", None), ("dateTime", "2024-02-28T24:00:00Z", "2024-02-29T00:00:00Z"), ("dateTime", "1999-12-31T24:00:00", "2000-01-01T00:00:00"),
    ("dateTime", "2001-01-01T01:02:03.0500+14:00", "2001-01-01T01:02:03.05+14:00"), ("gMonth", "--07", None), ("gMonth", "--07--Z", "--07Z"), ("gMonthDay", "--02-30", None), ("gDay", "---31-00:30", None), ("time", "23:59:60.5", None), ("time", "24:00:00Z", "00:00:00Z"),
])
def test_times_of_all_kinds(kind, text, canonical):
    schema = T.StructType([field("t", T.StringType(), xsd=kind)])
    for o in (C.Options(strict=True), C.Options()):
        r = W.Rows(schema, "r")
        assert r.decode(r.encode({"t": text}, o), o) == {"t": canonical or text}


def test_times_in_utc_and_invalid_ones():
    r = W.Rows(T.StructType([field("t", T.StringType(), xsd="dateTime")]), "r")
    o = C.Options(strict=True, utc=True)
    assert r.decode(r.encode({"t": "2000-01-01T00:30:00+01:00"}, o), o) == {"t": "1999-12-31T23:30:00Z"}
    for bad in ("2000-13-01T00:00:00", "2000-01-01", "x", "2000-01-01T25:00:00"):
        with pytest.raises(C.Invalid):
            r.encode({"t": bad}, o)
        loose = C.Options()
        assert M.Machine(r.schema, loose).decode(M.Machine(r.schema, loose).encode([SE("r"), SE("t"), CH(bad), EE, EE]))[2] == CH(bad)


def test_other_forms_of_values():
    schema = T.StructType([
        field("e", T.ArrayType(T.StringType()), extended=["red", "green", "blue"]), field("b", T.ArrayType(T.StringType()), pattern=True), field("c", T.StringType(), charset="zyxCBA"), field("u", T.LongType(), unsigned=True),
        field("x", T.BinaryType(), base64=True), field("t", T.TimestampType()),
    ])
    row = {"e": ["red", "pink", "pink", "blue", "", "a longer one"], "b": ["false", "0", "true", "1"], "c": "ABCxyz!", "u": 300, "x": b"\x00\xff", "t": dt.datetime(2020, 1, 2, 3, 4, 5, 600000, tzinfo=dt.timezone.utc)}
    for o in (C.Options(strict=True), C.Options(), C.Options(byte_aligned=True)):
        r = W.Rows(schema, "r")
        assert r.decode(r.encode(row, o), o) == row
    out = C.BitWriter()
    s = C.Strings()
    s.write_extended(out, "q", "blue", ["red", "green", "blue"])
    s.write_extended(out, "q", "no", ["red", "green", "blue"])
    s.write_extended(out, "q", "no", ["red", "green", "blue"])
    assert out.done() == int("00000010" + "10" + "00001000" + "01101110" + "01101111" + "00000000" + "000000", 2).to_bytes(6, "big")
    with pytest.raises(C.Invalid):
        C.Strings().read_extended(C.BitReader(b"\x04\x00"), "q", ["a"])


def test_lists_of_any_width_and_bits():
    source = C.BitReader(b"\xa5\xc3\x01")
    assert source.look_ahead() == 0xA5 and source.bits(4) == 0xA and source.look_ahead() == 0xC3 and source.octets(1) == b"\x5c"
    for n in (0, -1):
        with pytest.raises(C.Invalid):
            source.bits(n)
    source.align()
    assert source.octets(1) == b"\x01" and source.look_ahead() is None
    big = 10**60
    for n in (big, -big, 0, -1):
        out = C.BitWriter()
        out.integer(n)
        assert C.BitReader(out.done()).integer() == n


def test_representations():
    base = T.StructType([field("d", T.DecimalType(9, 2)), field("n", T.LongType()), field("small", T.LongType(), min=0, max=255), field("e", T.StringType(), enum=["a", "b"]), field("l", T.ArrayType(T.LongType()), list=True)])
    s = R.represented(base, {"decimal": "string", "integer": "decimal"})
    assert [f.metadata.get("represent") for f in s] == ["string", "decimal", "decimal", None, "decimal"]
    row = {"d": decimal.Decimal("1.50"), "n": -7, "small": 9, "e": "b", "l": [1, 2]}
    o = C.Options(strict=True)
    r = W.Rows(s, "r")
    assert r.decode(r.encode(row, o), o) == row
    assert R.represented(base, {}) == base and R.resolve("unsignedByte", {"integer": "integer"}) == "unsignedByte"
    R.register("hexadecimal", T.StringType(), {"charset": C.CHARSETS["hex"]})
    try:
        own = R.represented(T.StructType([field("n", T.LongType())]), {"integer": "hexadecimal"})
        r = W.Rows(own, "r")
        assert r.decode(r.encode({"n": 1234}, o), o) == {"n": 1234}
    finally:
        del wire.REPRESENTATIONS["hexadecimal"]
    with pytest.raises(C.Invalid):
        R.resolve("nothing", {})


@pytest.mark.parametrize("o", [
    C.Options(with_options=True, prefixes=True, lexical=True), C.Options(with_options=True, schema_id="urn:s"), C.Options(with_options=True, schema_id=""), C.Options(with_options=True, schema_id=M.NO_SCHEMA), C.Options(with_options=True, self_contained=True, capacity=0),
    C.Options(with_options=True, representations=(("{urn:a}t", "{http://www.w3.org/2009/exi}string"), ("{http://www.w3.org/2001/XMLSchema}decimal", "{http://www.w3.org/2009/exi}string"))), C.Options(with_options=True, max_productions=12, max_grammars=3, local=False),
])
def test_options_documents(o):
    out = C.BitWriter()
    C.write_header(out, o)
    assert C.read_header(out.done(), C.Options())[1] == o


def test_options_document_bits():
    # lesscommon 0 of 2 bits, uncommon 0 of 2; valueMaxLength is 2 of 7, value 9, then the end, 4 of 5, and two more
    out = C.BitWriter()
    C.write_header(out, C.Options(with_options=True, max_length=9))
    assert f"{int.from_bytes(out.done(), 'big'):b}".startswith("10100000" + "0" + "00" + "00" + "010" + "00001001")


def test_contradictions_are_refused():
    for o in (C.Options(strict=True, comments=True), C.Options(strict=True, prefixes=True), C.Options(canonical=True, cookie=True)):
        with pytest.raises(C.Invalid):
            M.Machine(None, o).encode([SE("r"), EE])


def test_body_only_and_canonical():
    doc = [SE("r"), AT("a", "1"), EE]
    o = C.Options(body_only=True)
    assert M.Machine(None, C.Options()).encode(doc)[1:] == M.Machine(None, o).encode(doc)
    assert back(None, o, doc) == doc
    assert back(None, C.Options(canonical=True), doc) == doc


@pytest.mark.parametrize("limits", [{"max_productions": 2}, {"max_grammars": 1}, {"max_grammars": 0, "max_productions": 0}])
def test_profile_limits(limits):
    s, o = Schema.of(PLAIN, "r"), C.Options(**limits)
    inner = [SE("u"), AT("x", "1"), SE("v"), CH("t"), EE, SE("w"), EE, SE("w"), SE("u"), CH("deep"), EE, EE, EE]
    doc = [SE("r"), *inner, SE("n"), CH("1"), EE, *inner, EE]
    got = back(s, o, doc)
    assert [e for e in got if e[1] is None or e[1][:2] != TYPE] == doc
    assert any(e[1] and e[1][:2] == TYPE for e in got)  # what may not learn is of any type


def test_fragments_learn():
    o = C.Options(fragment=True)
    doc = [SE("a"), EE, SE("a"), EE, SE("b"), EE, SE("a"), EE]
    assert back(None, o, doc) == doc
    s = Schema.of(PLAIN, "r")
    part = [SE("s"), CH("x"), EE, SE("n"), CH("1"), EE, SE("r"), SE("n"), CH("2"), EE, EE, SE("else"), EE]
    assert back(s, o, part) == part


def test_self_contained_with_a_schema():
    s, o = Schema.of(PLAIN, "r"), C.Options(self_contained=True)
    doc = [SE("r"), SE("u"), ("SC", None, None), AT("a", "b"), CH("long"), EE, SE("n"), CH("1"), EE, EE]
    assert back(s, o, doc) == doc
    assert M.Machine(s, o).decode(M.Machine(s, o).encode(doc), skip=True) == [*doc[:3], *doc[5:]]


def test_mapping_by_names():
    schema = T.StructType([W.tagged("ident", T.LongType(), "id,attr"), W.tagged("Title", T.StringType(), "urn:t title"), W.tagged("text", T.StringType(), ",chardata"), field("Price", T.DoubleType()), field("tags", T.ArrayType(T.StringType())), field("on", T.BooleanType()), field("list", T.ArrayType(T.LongType()), list=True)])
    f = field("r", schema, False)
    assert schema.names == ["_ident", "Title", "_VALUE", "Price", "tags", "on", "list"] and schema["Title"].metadata == {"name": "title", "ns": "urn:t"}
    xml = '<r id=" 7 "><title>T</title><unknown><title>no</title></unknown><PRICE> 1.5e2 </PRICE><tags>a</tags><tags/><on/><list> 1  2 </list>rest</r>'
    row = W.from_events(f, exi.parse_xml(xml))
    assert row == {"_ident": 7, "Title": "T", "_VALUE": "rest", "Price": 150.0, "tags": ["a", ""], "on": None, "list": [1, 2]}
    less = W.Rows(schema, "r", informed=False)
    row = {"_ident": 7, "Title": "T", "_VALUE": None, "Price": 1234567890123.5, "tags": [], "on": True, "list": [3]}
    assert ("CH", None, "1234567890123.5") in W.to_events(f, row, typed=False)
    got = less.decode(less.encode(row, C.Options()), C.Options())
    assert got | {"_VALUE": None} == row
    assert W.to_events(f, {"_ident": 1, "Title": ""}, typed=False)[2:4] == [SE("title", "urn:t"), CH("")]


def test_errors_name_a_reason():
    schema = T.StructType([field("a", T.ArrayType(T.LongType()))])
    with pytest.raises(C.Invalid, match="null"):
        C.Strict(schema, "r").encode({"a": [1, None]})
    with pytest.raises(C.Invalid):
        W.Rows(schema, "r").encode({"a": [1, None]}, C.Options())


def test_what_is_kept():
    strict, everything = C.Options(strict=True), C.Options.all_kept()
    assert strict.keeping("comments") == C.Options(comments=True)
    assert everything.keeping("strict") == C.Options(strict=True, lexical=True)
    assert strict.keeping("lexical") == C.Options(strict=True, lexical=True) and everything.keeping("pis", False) != everything
    with pytest.raises(C.Invalid):
        strict.keeping("colours")
    doc = [SE("r"), EE, SE("r"), EE]
    for limits in ({}, {"max_productions": 0}, {"max_grammars": 0}):
        o = C.Options(fragment=True, **limits)
        assert M.Machine(None, o).encode(doc) == M.Machine(None, C.Options(fragment=True)).encode(doc)
