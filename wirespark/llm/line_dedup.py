"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's share is the number of the host's pages that contain it over the number of all pages
of the host; lines whose share exceeds the boilerplate ratio, on least_pages pages or more, are dropped from the host's
pages. On small hosts, where that ratio is few pages, a line on fewer than least_pages pages is dropped too if it is on two
or more and on over SMALL_RATIO of the host's pages: of 4 pages, on 3. SQL doesn't have this; results differ from it on
hosts of 2 to 7 pages only. All of it is DataFrame functions: each page gives its distinct line hashes, counts combine
before the shuffle, and a host's dropped lines return to its pages, so that no text is shuffled as long as the hosts with
such lines are few enough to broadcast, and none is ever exploded.

The host is any column: a site's name, or host() of a URL. Lines are told apart by 64-bit hashes within a host. Lines without a word are neither counted nor dropped. A null host
is a host of its own; a null text stays null and counts as a page; a text that loses all its lines becomes empty. Equal
rows are pages each. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespark.llm.common import WORD, lookup, written

RATIO, LEAST_PAGES = 0.1, 5
#: The share of a small host's pages that a line on two pages or more must exceed.
SMALL_RATIO = 0.5


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def boilerplate(pages: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(_none, _host, _bad): the hashes of each host's lines to drop."""
    host = [F.col(host_col).isNull().alias("_none"), F.coalesce(host_col, F.lit("")).alias("_host")]
    lines = F.filter(F.split(text_col, "\n"), lambda x: x.rlike(WORD))
    totals = pages.groupBy(*host).agg(F.count("*").alias("_pages"))
    counts = pages.select(*host, F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("_line")).groupBy("_none", "_host", "_line").agg(F.count("*").alias("_on")).where(F.col("_on") >= min(2, least_pages))
    often = counts.join(totals, ["_none", "_host"]).where((F.col("_on") > F.lit(float(ratio)) * F.col("_pages")) & ((F.col("_on") >= least_pages) | (F.col("_on") > SMALL_RATIO * F.col("_pages"))))
    return often.groupBy("_none", "_host").agg(F.collect_set("_line").alias("_bad"))


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: bool = False) -> DataFrame:
    """pages without their hosts' boilerplate lines; counts: adds n_lines and n_dropped."""
    bad = written(boilerplate(pages, host_col, text_col, ratio, least_pages), "boilerplate")
    rows = pages.select(F.struct(*pages.columns).alias("_page"), F.col(host_col).isNull().alias("_none"), F.coalesce(host_col, F.lit("")).alias("_host"))
    rows = rows.join(lookup(bad, bad.count()), ["_none", "_host"], "left")
    lines = F.split(F.col(f"_page.{text_col}"), "\n")
    left = F.when(F.col("_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~(F.array_contains("_bad", F.xxhash64(x)) & x.rlike(WORD))))
    rows = rows.withColumn("_left", left)
    text = F.when(F.col("_bad").isNull(), F.col(f"_page.{text_col}")).otherwise(F.array_join("_left", "\n"))
    own = [(text if c == text_col else F.col(f"_page.{c}")).alias(c) for c in pages.columns if not (counts and c in ("n_lines", "n_dropped"))]
    more = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(lines) - F.size("_left"), F.lit(0)).cast("long").alias("n_dropped")]
    return rows.select(*own, *(more if counts else ()))


SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
counts AS (SELECT source, l, count(*) AS on_pages FROM (SELECT source, unnest(list_distinct(ls)) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY source, l),
bad AS (SELECT c.source, list(c.l) AS ls FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.on_pages >= {LEAST_PAGES} AND c.on_pages > {RATIO} * t.pages GROUP BY c.source),
done AS (SELECT d.doc_id, d.text, d.ls, CASE WHEN bad.ls IS NULL THEN d.ls ELSE list_filter(d.ls, lambda x: NOT list_contains(bad.ls, x)) END AS kept FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped FROM done
"""
