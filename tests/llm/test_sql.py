"""Queries against their SQL, in DuckDB, and the odd rows of line dedup and WARC."""

import html
import html.entities
import uuid

import duckdb
import pytest

from tests.llm.helpers import ODD, SCHEMA, rows
from wirespark.llm import line_dedup, warc
from wirespark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, size):
    d, con = f"/root/testdata/{size}", duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    df = QUERIES[name](spark, d)
    con.execute(ORACLE_SQL[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(con.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == want


def test_lines_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD] + [(100 + i, f"menu\n\nown {i}", "en", None, 0, 1) for i in range(8)], SCHEMA + ", _bad int")
    got = {r["doc_id"]: r for r in rows(line_dedup.drop_boilerplate(docs, "source", counts=True))}
    assert got[100]["text"] == "\nown 0" and got[100]["n_dropped"] == 1 and got[100]["n_lines"] == 3
    assert got[4]["text"] is None and got[5]["text"] == "" and got[6]["text"] == " \n\t "
    assert line_dedup.drop_boilerplate(docs, "source").columns == docs.columns
    assert rows(line_dedup.drop_boilerplate(docs.limit(0), "source")) == []


def test_lines_of_small_hosts(spark):
    made = [(h, f"foot\nhalf\nown {h} {i}" if i < h // 2 else f"foot\nown {h} {i}") for h in range(1, 9) for i in range(h)]
    docs = spark.createDataFrame([(i, t, f"host {h}") for i, (h, t) in enumerate(made)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in rows(line_dedup.drop_boilerplate(docs, "source"))}
    for i, (h, t) in enumerate(made):  # a one-page host keeps its text, and half of a small host's pages are too few
        assert got[i] == (t if h == 1 else t.replace("foot\n", "")), h


def test_warc_files_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/é", "<title> T\n t</title><p>x &lt;b&gt;</p><a href=1>y</a>"), (2, None, None), (2, None, ""), (None, "u", "plain")], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages)).repartition(2)
    path = f"file:///tmp/checkpoints/warc-{uuid.uuid4().hex}"
    assert len(warc.write(made, path)) == 2
    got = sorted((r["headers"]["WARC-Record-ID"], r["headers"]["WARC-Refers-To"], bytes(r["block"]).decode()) for r in rows(warc.read(spark, path)))
    assert got == sorted((r["record_id"], r["refers_to"], r["block"]) for r in rows(made))
    text = {r["block"] for r in rows(made) if r["warc_type"] == "conversion"}
    assert "x <b>\ny" in text and "plain" in text
    assert rows(warc.derivatives(warc.responses(pages.limit(0)))) == []


def test_warc_decodes_all_references(spark):
    names = "".join(f"<b>&{n}</b>" for n in html.entities.html5 if n not in ("nbsp", "nbsp;", "NonBreakingSpace;", "Tab;", "NewLine;"))
    bodies = [names, "&#64;&#x40;&#X41;&#8364;&#128;&#0;&#xD800;&#99999999;x", "&amp;copy; &amp;#64; &amp;amp; &lt;p&gt; &nosuch; & &copyx", "a&nbsp;b&#160;c&#xa0;d&#1601;e&nbsp", "a&#10;&#32;&Tab;b"]
    pages = spark.createDataFrame([(i, "u", f"<title>{b.replace('<b>', '').replace('</b>', '')}</title><p>{b}</p>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    made = rows(warc.derivatives(warc.responses(pages)))
    text = {r["page_id"]: r["block"] for r in made if r["warc_type"] == "conversion"}
    title = {r["page_id"]: r["block"].split("title: ")[1].split("\r\noutlinks")[0] for r in made if r["warc_type"] == "metadata"}
    bare = [b.replace("<b>", "").replace("</b>", "") for b in bodies]
    assert text[0] == html.unescape(bare[0]).strip(" \n")
    assert text[1] == title[1] == html.unescape(bare[1]) and text[2] == title[2] == html.unescape(bare[2])
    assert text[3] == title[3] == "a b c d\u0641e" and text[4] == "a\n\tb" and title[4] == "a b"


def test_warc_references_of_pages(spark, data):
    made = {(r["page_id"], r["warc_type"]): r for r in rows(QUERIES["op9_warc_derivatives"](spark, data))}
    pages = {r["page_id"]: r["html"] for r in rows(spark.read.parquet(f"{data}/pages.parquet"))}
    assert any("&copy;" in x for x in pages.values()) and not any("&copy;" in r["block"] or "&middot;" in r["block"] for r in made.values())
    assert len({r["record_id"] for r in made.values()}) == len(made) == 2 * len(pages)


def test_warc_clashes_long_pages_and_urls_with_line_ends(spark):
    long = "<p>" + "word &amp; " * 200_000 + "</p>"
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", long, "k"), (2, "http://a/", "same", "k"), (3, "http://a/", "same", "k"), (3, "http://a/", "same", "k")], "page_id long, url string, html string, block string")
    made = rows(warc.derivatives(warc.responses(pages, keep=("page_id", "block")), keep=("page_id", "block")))
    assert {r["block_"] for r in made} == {"k"} and len(made) == 8
    assert len({r["record_id"] for r in made}) == 6  # rows equal in all are one page twice
    assert all("\r\nX:" not in r["header"] and "%0D%0AX: y" in r["target_uri"] for r in made if r["page_id"] == 1)
    assert next(r["block"] for r in made if r["page_id"] == 1 and r["warc_type"] == "conversion") == ("word & " * 200_000).strip()


def test_hosts_of_urls(spark):
    urls = {"http://www.A.example.com:80/x?y#z": "www.a.example.com", "https://u:p@b.example/": "b.example", "//c.example/x": "c.example", "d.example/x": None, "http:///x": None, "mailto:e@f": None, "": None, None: None, "http://[2001:db8::1]:8080/": "[2001:db8::1]", "HTTPS://É.example": "é.example"}
    got = {r["u"]: r["h"] for r in rows(spark.createDataFrame([(u,) for u in urls], "u string").select("u", line_dedup.host(line_dedup.F.col("u")).alias("h")))}
    assert got == urls
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.example/{i}", f"menu\nown {i}") for i in range(20)], "id long, url string, text string")
    left = rows(line_dedup.drop_boilerplate(pages.withColumn("site", line_dedup.host(line_dedup.F.col("url"))), "site"))
    assert {r["text"] for r in left} == {f"own {i}" for i in range(20)}
