"""Documents as ordered event tables: doc_id, seq, depth, event, local, value, path.

Events: SD, SE, AT, CH, EE, ED. A row, or an array of rows, becomes a document; a null field is an absent element. All of
it is projection and generation on one row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _event(kind: str, local: Column | None = None, value: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("event"), (none if local is None else local).alias("local"), (none if value is None else value).alias("value"))


def from_rows(df: DataFrame, doc_id: Column, root: str, fields: list[str], attributes: list[str] = ()) -> DataFrame:
    """(doc_id, seq, event, local, value): each row as a document of one element, its fields as child elements in order."""
    name, empty = F.lit(root), F.array().cast("array<struct<event:string,local:string,value:string>>")
    at = [F.when(F.col(c).isNotNull(), F.array(_event("AT", F.lit(c), F.col(c).cast("string")))).otherwise(empty) for c in attributes]
    own = [F.when(F.col(c).isNotNull(), F.array(_event("SE", F.lit(c)), _event("CH", None, F.col(c).cast("string")), _event("EE", F.lit(c)))).otherwise(empty) for c in fields]
    all_ = F.concat(F.array(_event("SD"), _event("SE", name)), *at, *own, F.array(_event("EE", name), _event("ED")))
    return df.select(doc_id.cast("long").alias("doc_id"), F.posexplode(all_).alias("seq", "e")).select("doc_id", F.col("seq").cast("long").alias("seq"), "e.event", "e.local", "e.value")


def with_depth(events: DataFrame) -> DataFrame:
    """events with depth (of an element its own, of its content the same) and parent_seq, the SE around it."""
    by = Window.partitionBy("doc_id").orderBy("seq")
    step = F.when(F.col("event") == "SE", 1).when(F.col("event") == "EE", -1).otherwise(0)
    up = F.sum(step).over(by.rowsBetween(Window.unboundedPreceding, 0))
    deep = events.withColumn("depth", (up + (F.col("event") == "EE").cast("int")).cast("long"))
    inner = (F.col("depth") - (F.col("event").isin("SE", "EE")).cast("int")).cast("long")
    deep = deep.withColumn("_in", inner)
    # each event asks at its level for the last SE before it; an SE also answers at its own level
    asks = F.array(F.struct(F.col("_in").alias("level"), F.lit(None).cast("long").alias("se")))
    both = F.when(F.col("event") == "SE", F.concat(asks, F.array(F.struct(F.col("depth").alias("level"), F.col("seq").alias("se"))))).otherwise(asks)
    rows = deep.withColumn("_r", F.explode(both)).drop("_in")
    level = Window.partitionBy("doc_id", "_r.level").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("parent_seq", F.last("_r.se", ignorenulls=True).over(level)).where("_r.se is null").drop("_r")


def merged_text(texts: DataFrame, doc: str, seq: str, group: str, text: str) -> DataFrame:
    """Adjacent texts of one group in a document, joined in order: (doc, first seq, group, text)."""
    by = Window.partitionBy(doc).orderBy(seq)
    new = F.when(F.lag(group).over(by) == F.col(group), 0).otherwise(1)
    runs = texts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(text).alias("t"))))
    return runs.groupBy(doc, "_run", group).agg(F.min(seq).alias(seq), F.array_join(F.transform(parts, lambda p: p["t"]), "").alias(text)).drop("_run")


def ordered_attributes(attributes: Column) -> Column:
    """An array of (ns, local, value) in wire order: namespaces, xsi:type, xsi:nil (unless false), then by local name and namespace; xsi:schemaLocation is dropped."""
    xsi = "http://www.w3.org/2001/XMLSchema-instance"
    rank = lambda a: F.when(a["ns"] == "http://www.w3.org/2000/xmlns/", 0).when((a["ns"] == xsi) & (a["local"] == "type"), 1).when((a["ns"] == xsi) & (a["local"] == "nil"), 2).otherwise(3)
    dropped = lambda a: (a["ns"] == xsi) & (a["local"].isin("schemaLocation", "noNamespaceSchemaLocation") | ((a["local"] == "nil") & (F.trim(a["value"]).isin("false", "0"))))
    keyed = F.transform(F.filter(attributes, lambda a: ~dropped(a)), lambda a: F.struct(rank(a).alias("rank"), a["local"].alias("local"), a["ns"].alias("ns"), a["value"].alias("value")))
    return F.array_sort(keyed)


def elements(events: DataFrame) -> DataFrame:
    """(doc_id, start, stop) of each element of an event table: the places of its SE and its EE."""
    by = Window.partitionBy("doc_id").orderBy("seq")
    step = F.when(F.col("event") == "SE", 1).when(F.col("event") == "EE", -1).otherwise(0)
    up = F.sum(step).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ends = events.select("doc_id", "seq", "event", (up + (F.col("event") == "EE").cast("int")).alias("depth")).where("event in ('SE', 'EE')")
    stop = F.lead("seq").over(Window.partitionBy("doc_id", "depth").orderBy("seq"))
    return ends.withColumn("stop", stop).where("event = 'SE'").select("doc_id", F.col("seq").alias("start"), "stop")


def in_scope(uses: DataFrame, declared: DataFrame, events: DataFrame, key: str, value: str) -> DataFrame:
    """uses (doc_id, seq, key) with `value`, what the innermost element around says of the key; declared: (doc_id, seq, key, value), seq the place of the declaring element's SE. Null where none says anything. Serves prefixes, URIs, xml:space and the like."""
    spans = declared.join(elements(events).withColumnRenamed("start", "seq"), ["doc_id", "seq"]).select("doc_id", F.col("seq").alias("_from"), F.col("stop").alias("_to"), key, value)
    hit = uses.join(spans, (uses["doc_id"] == spans["doc_id"]) & uses[key].eqNullSafe(spans[key]) & uses["seq"].between(spans["_from"], spans["_to"]), "left")
    return hit.groupBy(uses["doc_id"], uses["seq"], uses[key]).agg(F.max_by(spans[value], spans["_from"]).alias(value))


def coalesced(events: DataFrame, keep: Column | None = None) -> DataFrame:
    """An event table whose adjacent CH are one, without those of white space alone beside child elements (kept where `keep` holds, as under xml:space): text between a start tag and its end stays as it is."""
    by = Window.partitionBy("doc_id").orderBy("seq")
    run = F.sum(F.when((F.col("event") == "CH") & (F.lag("event").over(by) == "CH"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    keep = F.lit(False) if keep is None else keep
    parts = F.array_sort(F.collect_list(F.when(F.col("event") == "CH", F.struct("seq", F.col("value").alias("t")))))
    whole = events.withColumn("_run", run).withColumn("_keep", keep).groupBy("doc_id", "_run").agg(F.min("seq").alias("seq"), F.first("event").alias("event"), F.first("local").alias("local"), F.when(F.first("event") == "CH", F.array_join(F.transform(parts, lambda p: p["t"]), "")).otherwise(F.first("value")).alias("value"), F.max("_keep").alias("_keep"))
    by = Window.partitionBy("doc_id").orderBy("seq")
    simple = F.lag("event").over(by).isin("SE", "AT", "NS") & F.lead("event").over(by).isin("EE", "CM", "PI", "DT")
    blank = (F.col("event") == "CH") & F.col("value").rlike(r"^[ \t\r\n]*\z")
    kept = whole.withColumn("_simple", F.coalesce(simple, F.lit(False)))
    return kept.where(~blank | (F.col("_simple") & (F.col("value") != "")) | F.col("_keep")).select("doc_id", "seq", "event", "local", "value")
