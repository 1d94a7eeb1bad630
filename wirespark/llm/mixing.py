"""Mixing sources to target weights by Pareto order sampling.

Within a source the expected copies of a document are in proportion to its weight: a column, or by default a power of its
size (WEIGHT_POWER), up to the most copies allowed; what these can't take goes to the others, so that the source's expected words
are its target. The whole part of a document's expected copies are certain copies. For the rest, its inclusion odds, the
documents of a source are ranked by random odds over inclusion odds, Q = (U / (1 - U)) / (p / (1 - p)), and the sample is
the front of that order whose words come nearest to what the target still lacks: the sample has a fixed size, in words.
U is a hash of the row, so reruns agree; rows equal in id and text have equal U and are drawn together. Weights count by
class, GRID classes to a doubling.

The place where the front ends is found digit by digit of the rank (256 sums a source and level), so no source, however
hot, is sorted in one task; only the last cell, a 2^-24 part of a source, is ordered row by row.

Null sources are a source of their own, ordered last; null and empty texts have size 0 and are taken 0 words. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespark.llm.common import WORD, discard, lookup, row_hash, written

BITS, DIGIT, LEVELS = 48, 8, 3
KEYS = ("_none", "_src")
#: Expected copies grow with this power of the size; classes of weights to a doubling.
WEIGHT_POWER, GRID = 0.25, 8


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """A written df with 0-based numbers in a total order: a distributed sort plus the row counts of its partitions."""
    parts = written(df.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "ranked")
    starts, at = [], 0
    for p, n in sorted(parts.groupBy("_p").count().collect()):  # one number a partition
        starts.append((p, at))
        at += n
    starts_df = df.sparkSession.createDataFrame(starts, "_p int, _s long")
    return parts.join(lookup(starts_df, len(starts)), "_p").withColumn(name, F.col("_s") + F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_p", "_i", "_s")


def shares(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """(sources with weight and target, number of sources). Targets share `share` of all sizes by weight; what is above `most` times a source's size is reshared among the others until none is above."""
    sources = written(sources, "sources")
    n_all = sources.agg(F.sum("source_size").alias("s"), F.count("*").alias("n")).first()
    order = [F.col("_none").asc(), F.col("_src").asc()]  # bytes of UTF-8 sort as code points
    one = ranked(sources, *order)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    one = written(one.withColumn("weight", cycle).drop("rank"), "weights")
    total, level = share * (n_all["s"] or 0), 0.0
    cap = F.col("source_size") * F.lit(float(most))
    while n_all["n"]:
        above = F.col("weight") * F.lit(level) > cap
        r = one.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        new = (total - r["capped"]) / r["open"] if r["open"] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return one.withColumn("target", F.least(cap, F.col("weight") * F.lit(level))), n_all["n"]


def _keyed(docs: DataFrame, *columns: Column, weight_col: str | None, seed: int) -> DataFrame:
    """The columns, and what a row's place in the mix depends on."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    weight = F.pow(size, F.lit(WEIGHT_POWER)) if weight_col is None else F.col(weight_col).cast("double")
    # null: a weight of none, and no size
    weight = F.when((weight > 0) & ~F.isnan(weight), F.round(F.log2(F.least(weight, F.lit(1e300))) * GRID)).cast("long")
    return docs.select(*columns, F.col("doc_id").alias("_doc_id"), F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_src"), size.alias("_size"), row_hash("doc_id", "text", F.lit(seed)).alias("_h"), weight.alias("_class"))


def _weight() -> Column:
    return F.pow(F.lit(2.0), F.col("_class") / GRID)


def _scales(cells: DataFrame, most: float) -> DataFrame:
    """(keys, _scale) from the sizes (_s) of sources' classes of weights: the factor by which weights give expected copies, at most floor(most) of each, whose words are the source's target. The heaviest classes are those at the limit."""
    down, top = Window.partitionBy(*KEYS).orderBy(F.col("_class").desc()), float(int(most))
    full = F.coalesce(F.sum("_s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(top)
    rest = F.sum(F.col("_s") * _weight()).over(down.rowsBetween(0, Window.unboundedFollowing))
    scale = cells.where("_class is not null").withColumn("_scale", F.when(rest > 0, (F.col("target") - full) / rest))
    return scale.where(F.col("_scale") * _weight() <= F.lit(top * (1 + 1e-12))).groupBy(*KEYS).agg(F.max("_scale").alias("_scale"))


def _ordered(rows: DataFrame, most: float) -> DataFrame:
    """rows (keyed, with their source's _scale; null: all are at the limit) with _k certain copies and _key, the rank among those for the rest (null: there is none)."""
    top = F.lit(float(int(most)))
    rate = F.coalesce(F.least(F.round(F.coalesce(F.col("_scale") * _weight(), top), 12), top), F.lit(0.0))
    rate = F.when(F.col("_class").isNull() | (rate < 0), 0.0).otherwise(rate)
    rows = rows.withColumn("_rate", rate).withColumn("_k", F.floor("_rate"))
    u = (F.shiftrightunsigned("_h", 11).cast("double") + 0.5) * F.lit(2.0**-53)
    p = F.col("_rate") - F.col("_k")
    q = (u / (1 - u)) * ((1 - p) / p)
    return rows.withColumn("_key", F.when(p > 0, F.least(F.floor(q / (1 + q) * F.lit(2.0**BITS)), F.lit((1 << BITS) - 1))).cast("long"))


def _place() -> Column:
    return F.struct(F.col("_key"), F.coalesce("_doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("_h"))


def _taken(rows: DataFrame) -> DataFrame:
    """Ordered rows with _end, the last place that is taken, given their copies."""
    return rows.withColumn("copies", F.col("_k") + F.coalesce((F.col("_key").isNotNull() & (_place() <= F.col("_end"))).cast("long"), F.lit(0)))


def _plan(slim: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame, int]:
    """(one row a source with target and _end, written; the ordered slim rows, written; number of sources)."""
    cells = written(slim.groupBy(*KEYS, "_class").agg(F.sum("_size").alias("_s")), "mix-classes")
    targets, n = shares(cells.groupBy(*KEYS).agg(F.sum("_s").alias("source_size")), weights, share, most)
    targets = targets.join(_scales(cells.join(lookup(targets, n), list(KEYS)), most), list(KEYS), "left")
    targets = written(targets.select(*KEYS, "source_size", "target", "_scale"), "mix-targets")
    rows = written(_ordered(slim.join(lookup(targets, n), list(KEYS)), most), "mix-rows")
    plan = targets.join(_ends(rows), list(KEYS), "left")
    return written(plan, "mix-plan"), rows, n


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, weight_col: str | None = None, seed: int = 20) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies of every row of docs (doc_id, text, source).

    weight_col: relative expected copies of a document within its source (null, not a number or not positive: 0), else by size. No
    document is taken more than `most` times (whole copies, so floor(most)).
    """
    slim = written(_keyed(docs, weight_col=weight_col, seed=seed), "mix-sizes")
    plan, rows, n = _plan(slim, weights, share, most)
    discard(slim)
    out = _taken(rows.join(lookup(plan.select(*KEYS, "_end"), n), list(KEYS)))
    return out.select(F.col("_doc_id").alias("doc_id"), F.when(~F.col("_none"), F.col("_src")).alias("source"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, weight_col: str | None = None, seed: int = 20) -> DataFrame:
    """docs with each row as often as the mix takes it; rows of no words, which weigh nothing, stay as they are."""
    slim = written(_keyed(docs, weight_col=weight_col, seed=seed), "mix-sizes")
    plan, rows, n = _plan(slim, weights, share, most)
    for t in (slim, rows):
        discard(t)
    whole = _keyed(docs, F.struct(*docs.columns).alias("_doc"), weight_col=weight_col, seed=seed)
    taken = _taken(_ordered(whole.join(lookup(plan, n), list(KEYS)), most))
    times = F.when(F.col("_size") == 0, 1).otherwise(F.col("copies")).cast("int")
    return taken.select("_doc", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select("_doc.*")


def _ends(rows: DataFrame) -> DataFrame:
    """(keys, _end): the last place in a source's order that is taken."""
    lack = rows.groupBy(*KEYS).agg((F.first("target") - F.sum(F.col("_size") * F.col("_k"))).alias("_lack"), F.count("*").alias("_n"))
    cells = written(lack.where("_lack > 1e-6").withColumns({"_cell": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")}), "mix-cells")
    n = cells.count()
    open_rows = rows.where("_key is not null and _size > 0").select(*KEYS, "_doc_id", "_size", "_key", "_h")
    within = Window.partitionBy(*KEYS).orderBy("_cell")
    for level in range(1, LEVELS + 1):
        at = F.shiftright("_key", BITS - DIGIT * level)
        inside = open_rows.join(lookup(cells.select(*KEYS, "_lack", "_before", F.col("_cell").alias("_up")), n), list(KEYS)).where(F.shiftright(at, DIGIT) == F.col("_up"))
        sums = inside.groupBy(*KEYS, at.alias("_cell")).agg(F.sum("_size").alias("_s"), F.first("_lack").alias("_lack"), F.first("_before").alias("_start"))
        run = sums.withColumn("_to", F.col("_start") + F.sum("_s").over(within)).withColumn("_left", F.max("_cell").over(Window.partitionBy(*KEYS)))
        hit = run.withColumn("_before", F.col("_to") - F.col("_s")).where((F.col("_before") < F.col("_lack")) & ((F.col("_to") >= F.col("_lack")) | (F.col("_cell") == F.col("_left"))))
        cells = written(hit.select(*KEYS, "_lack", "_cell", "_before"), "mix-cells")
    at = F.shiftright("_key", BITS - DIGIT * LEVELS)
    last = open_rows.join(lookup(cells, n), list(KEYS)).where(at == F.col("_cell"))
    last = last.withColumn("_place", _place())
    run = last.withColumn("_to", F.col("_before") + F.sum("_size").over(Window.partitionBy(*KEYS).orderBy("_place")))
    near = run.where(F.col("_to") - F.col("_lack") < F.col("_lack") - (F.col("_to") - F.col("_size")))
    taken = near.groupBy(*KEYS).agg(F.max("_place").alias("_end"))
    start = F.struct(F.shiftleft("_cell", BITS - DIGIT * LEVELS).alias("_key"), F.lit(-(1 << 63)).alias("_id"), F.lit(-(1 << 63)).alias("_h"))
    return cells.join(taken, list(KEYS), "left").select(*KEYS, F.coalesce("_end", start).alias("_end"))
