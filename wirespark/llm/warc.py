"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both point to their response by WARC-Refers-To and repeat its target, date and payload digest; the metadata record holds
the response's own HTTP headers, the title and the number of links, the conversion record the page's text. All named and
numeric character references are decoded, once, in text and title (spans of white space they make are then tidied as any
other; a no-break space becomes a space). Records are built with DataFrame functions and one Arrow function for the
references, one response at a time: no shuffle. Record ids are digests of what they name, so reruns
give equal records. write() makes one .warc.gz file a partition, one gzip member a record; read() parses such files.

Ids are made from the columns carried along (`keep`), URL, date and payload, so pages with ids of their own have records of
their own; rows equal in all of these are one page twice and give equal records. Control characters in a URL are
percent-encoded, so that none ends a header line. A null URL or payload counts as empty, and an empty payload gives an
empty conversion block. An empty table gives no records. A column to be carried along whose name is one of the output's
gets a `_` behind its name.
"""

from __future__ import annotations

import gzip
import html as markup
import html.entities
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Elements that end a line of text.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
SPACE = "[ \t\r\n\f]"
#: (pattern, replacement) in order, before and after entities are replaced; they hold in Java and in RE2 alike.
TO_TEXT = (
    ("(?is)<!--.*?-->|" + "|".join(f"<{x}(?:{SPACE}[^>]*)?>.*?</{x}{SPACE}*>" for x in ("head", "title", "script", "style")), ""),
    (f"{SPACE}+", " "),
    (f"(?i)</?(?:{BLOCKS})(?:[ /][^>]*)?>", "\n"),
    ("<[^>]*>", ""),
)
TIDY = ((" *\n[ \n]*", "\n"), ("  +", " "))
TITLE = "(?is)<title[^>]*>(.*?)</title"
LINK = "(?i)<a[ \t\r\n\f][^>]*href="


NO_BREAK = re.compile(r"&(?:nbsp|#0*160(?![0-9])|#[xX]0*[aA]0(?![0-9a-fA-F]));?")


def decoded(text: str) -> str:
    """text with its character references replaced as HTML has it, each once."""
    return markup.unescape(NO_BREAK.sub(" ", text))


@F.arrow_udf(StringType())
def _decode(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or "&" not in t else decoded(t) for t in texts.to_pylist()], pa.string())


def plain_text(html: Column) -> Column:
    for pattern, put in TO_TEXT:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(put))
    html = _decode(html)
    for pattern, put in TIDY:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(put))
    return F.btrim(html, F.lit(" \n"))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def _digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[x for name, value in pairs for x in (F.lit(f"{name}: "), value, F.lit(CRLF))])


#: Columns of responses and of their derivatives.
OWN = frozenset("record_id target_uri date http_headers payload payload_digest warc_type refers_to source_digest block_digest header block kind r".split())


def one_line(url: Column) -> Column:
    """A URL without characters that would end a header line."""
    for c in ("\r", "\n", "\t", "\0"):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return url


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id",), date: str = DATE) -> DataFrame:
    """(keep..., record_id, target_uri, date, http_headers, payload, payload_digest) of fetched pages."""
    url, html = one_line(F.coalesce(url_col, F.lit(""))), F.coalesce(html_col, F.lit(""))
    size = F.octet_length(html).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF))
    kept = [F.col(c).alias(c + "_" * (c in OWN)) for c in keep]
    made = pages.select(*kept, url.alias("target_uri"), F.lit(date).alias("date"), http.alias("http_headers"), html.alias("payload"), _digest(html).alias("payload_digest"))
    own = [F.coalesce(F.col(c + "_" * (c in OWN)).cast("string"), F.lit("")) for c in keep]
    return made.withColumn("record_id", _urn(F.lit("response"), *own, F.col("target_uri"), F.col("date"), F.col("payload_digest")))


def derivatives(records: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keep..., warc_type, record_id, refers_to, target_uri, source_digest, block_digest, header, block): two rows a response."""
    keep = [c + "_" * (c in OWN) for c in keep]
    payload = F.col("payload")
    title = F.regexp_extract(payload, TITLE, 1)
    title = F.trim(F.regexp_replace(_decode(title), "[ \t\r\n\f]+", " "))
    text = plain_text(payload)
    links = F.regexp_count(payload, F.lit(LINK)).cast("string")
    fields = F.concat(F.regexp_replace("http_headers", F.lit("(?m)^([A-Za-z-]+): "), F.lit("http-header-$1: ")), _lines(("title", title), ("outlinks", links)))
    made = lambda kind, content, block: F.struct(F.lit(kind).alias("warc_type"), F.lit(content).alias("kind"), block.alias("block"))
    both = F.array(made("metadata", "application/warc-fields", fields), made("conversion", "text/plain; charset=utf-8", text))
    base = records.select(*keep, "target_uri", "date", "payload_digest", F.col("record_id").alias("refers_to"), F.explode(both).alias("r"))
    base = base.select(*keep, "target_uri", "date", "payload_digest", "refers_to", "r.*").withColumn("record_id", _urn(F.col("warc_type"), F.col("refers_to"))).withColumn("block_digest", _digest(F.col("block")))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _lines(
            ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")),
            ("WARC-Date", F.col("date")), ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("kind")), ("Content-Length", F.octet_length("block").cast("string")),
        ),
    )
    return base.select(*keep, "warc_type", "record_id", "refers_to", "target_uri", F.col("payload_digest").alias("source_digest"), "block_digest", header.alias("header"), "block")


def write(records: DataFrame, path: str) -> list[str]:
    """Writes header and block of all records below path, a URI that driver and executors share; the files' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        name = f"part-{task.partitionId():06d}.warc.gz"
        store.create_dir(root, recursive=True)
        # an attempt's own file, then a rename: a second attempt writes the same bytes
        own = f"{root}/.{name}.{task.taskAttemptId()}"
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for header, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out.write(gzip.compress(f"{header}{CRLF}{block}{CRLF}{CRLF}".encode(), 6, mtime=0))
        store.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return sorted(r[0] for r in records.select("header", "block").mapInArrow(run, "name string").collect())


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in a file's bytes."""
    with gzip.open(io.BytesIO(data)) as f:
        while version := f.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                fields[name] = value.strip()
            block = f.read(int(fields["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record's end is missing")
            yield fields, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block) of all records in the files below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                heads, blocks = zip(*parse(data), strict=True) if data else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h in heads], pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], ["headers", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(run, "headers map<string,string>, block binary")


def _sql() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'" if not any(c in s for c in "\r\n\t\f") else " || ".join(f"chr({ord(c)})" if c in "\r\n\t\f" else q(c) for c in s)

    def replaced(x: str, pairs) -> str:
        for pattern, put in pairs:
            pattern = pattern.replace("\r", r"\r").replace("\n", r"\n").replace("\t", r"\t").replace("\f", r"\f")
            x = f"regexp_replace({x}, {q(pattern)}, {q(put)}, 'g')"
        return x

    def decoded(x: str) -> str:
        """References that end in a semicolon, each once; the tables have no others."""
        ref = "'^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);'"
        name = f"regexp_extract(p, {ref}, 1)"
        number = f"CASE WHEN {name} ILIKE '#x%' THEN CAST('0x' || substr({name}, 3) AS INTEGER) ELSE CAST(substr({name}, 2) AS INTEGER) END"
        put = f"CASE WHEN {name} LIKE '#%' THEN (CASE WHEN {number} = 160 THEN ' ' ELSE chr({number}) END) ELSE names[{name}] END"
        piece = f"CASE WHEN regexp_matches(p, {ref}) AND ({name} LIKE '#%' OR names[{name}] IS NOT NULL) THEN {put} || substr(p, length({name}) + 2) ELSE '&' || p END"
        return f"(SELECT coalesce(ps[1], '') || array_to_string(list_transform(ps[2:], lambda p: {piece}), '') FROM (SELECT string_split({x}, '&') AS ps))"

    names = {k.removesuffix(";"): " " if k == "nbsp;" else v for k, v in markup.entities.html5.items() if k.endswith(";") and len(v) == 1}
    table = f"map([{', '.join(q(k) for k in names)}], [{', '.join(f'chr({ord(v)})' for v in names.values())}])"
    text = f"trim({replaced(decoded(replaced('payload', TO_TEXT)), TIDY)}, ' ' || chr(10))"
    urn = lambda x: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({x}) AS h))"
    end = "chr(13) || chr(10)"
    space = r"[ \t\r\n\f]"
    head = " || ".join(
        f"'{name}: ' || {value} || {end}"
        for name, value in (
            ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Target-URI", "target_uri"),
            ("WARC-Date", "date"), ("WARC-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "kind"), ("Content-Length", "CAST(octet_length(encode(block)) AS VARCHAR)"),
        )
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, '{DATE}' AS date, coalesce(html, '') AS payload, {table} AS names FROM pages),
r AS (SELECT *, 'sha256:' || sha256(payload) AS source_digest FROM p),
s AS (SELECT *, {urn("'response|' || CAST(page_id AS VARCHAR) || '|' || target_uri || '|' || date || '|' || source_digest")} AS refers_to,
  trim(regexp_replace({decoded(f"regexp_extract(payload, '{TITLE}', 1)")}, '{space}+', ' ', 'g')) AS title, len(regexp_extract_all(payload, '(?i)<a{space}[^>]*href=')) AS links FROM r),
b AS (SELECT page_id, target_uri, date, source_digest, refers_to, 'metadata' AS warc_type, 'application/warc-fields' AS kind,
  'HTTP/1.1 200 OK' || {end} || 'http-header-Content-Type: text/html; charset=utf-8' || {end} || 'http-header-Content-Length: ' || CAST(octet_length(encode(payload)) AS VARCHAR) || {end} || 'title: ' || title || {end} || 'outlinks: ' || CAST(links AS VARCHAR) || {end} AS block FROM s
  UNION ALL SELECT page_id, target_uri, date, source_digest, refers_to, 'conversion', 'text/plain; charset=utf-8', {text} FROM s),
n AS (SELECT *, {urn("warc_type || '|' || refers_to")} AS record_id, 'sha256:' || sha256(block) AS block_digest FROM b)
SELECT page_id, warc_type, record_id, refers_to, target_uri, source_digest, block_digest, 'WARC/1.1' || {end} || {head} AS header, block FROM n
"""


SQL = _sql()
