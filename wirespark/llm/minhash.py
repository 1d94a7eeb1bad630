"""MinHash near-duplicates with bottom-k sketches from one hash function.

A document's set is its distinct word shingles, hashed once to 64 bits; the sketch is the k least hashes. Documents with
equal sets are one node. Inverted lists of the retained values give overlaps: a node needs at least a part LEAST of its
sketch in common with a partner (a binomial tail of chance says so: 1e-10 at a similarity of 0.85, 2.6e-8 at 0.8), so
only its rarest values beyond that part are listed, and values that no other node has count as rarest. Pairs from the
lists are filtered by the union-sketch estimate and confirmed by the exact Jaccard similarity of the full sets.

Lists are not paired out. First every node of a list meets its most central node; the links found merge nodes into
components. The nodes of lists that still hold several components are then compared by bitmaps of their full sets, in
blocks of bounded size, and only pairs that the bitmaps allow leave a block: first a few for each node, then, when what
they link is merged, all. For the nodes of lists longer than a block the rarest shingles of the full sets make narrower
lists first. No partner is capped: what is skipped is already connected. Equal texts were merged.

Shingles: n words, lower-cased in ASCII only; a text with fewer words is one shingle; a text without words (null, empty,
blank) has an empty set and no links. Rows equal in id stand for themselves; a null id never is a component's smallest
unless all its ids are null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespark.llm.common import BROADCAST_ROWS, coded, discard, filtered, lookup, lowered, mix64, row_hash, slices, split_words, texts_of, word_hashes, written
from wirespark.llm.links import BLOCK, bitmap, list_components

CHUNK_BYTES = 4 << 20
SKETCH, LEAST = 32, 0.375
#: The union-sketch filter drops a pair at the threshold with a lesser chance than this.
FILTER_TAIL = 1e-12


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    words, at = split_words(lowered(texts))
    codes, distinct = coded(words)
    w = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    h = np.full(max(0, len(w) - n + 1), n, np.uint64)
    for k in range(n):
        h = mix64(h * step + w[k : k + len(h)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = mix64(x * step + w[k])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, n: int, k: int = SKETCH) -> DataFrame:
    """(doc_id, row, n_shingles, node, sketch); node: a 128-bit digest of the whole set; row: a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            sets = shingle_sets(texts_of(batch.column("text")), n)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            nodes = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), sizes, nodes, _arrays([s[:k] for s in sets])], ["doc_id", "row", "n_shingles", "node", "sketch"])

    slim = docs.select("doc_id", "text", row_hash("doc_id", "text").alias("row"))
    return slim.mapInArrow(run, "doc_id long, row long, n_shingles long, node binary, sketch array<long>")


def _full_sets(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(node, set, bits) of the rows that stand for nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            sets = shingle_sets(texts_of(batch.column("text")), n)
            yield pa.RecordBatch.from_arrays([batch.column("node"), _arrays(sets), _arrays([bitmap(s) for s in sets])], ["node", "set", "bits"])

    rows = docs.select("text", row_hash("doc_id", "text").alias("row")).join(reps, "row").select("node", "text")
    return rows.mapInArrow(run, "node binary, set array<long>, bits array<long>").dropDuplicates(["node"])


def _close(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * inter >= percent * (a + b - inter)


def least_overlap(p: float, k: int) -> int:
    """The most values out of k that a pair of similarity p shares fewer of with a chance of at most FILTER_TAIL: a binomial tail."""
    below = 0.0
    for t in range(k):
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > FILTER_TAIL:
            return t
    return k


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; the union-sketch estimate is asked first."""
    pairs = written(pairs, "pairs")
    nodes = _named_in(nodes, pairs)
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    asked = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    likely = written(asked.where(both * k >= least_overlap(percent / 100, k) * F.size(union)).select("a", "b", "n_a", "n_b"), "likely-pairs")
    sets = _named_in(sets, likely)
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("set").alias("f_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("f_b")), "b")
    inter = F.size(F.array_intersect("f_a", "f_b")).cast("long")
    return full.where(_close(inter, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _named_in(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of table whose nodes are in pairs (written): the others needn't be shuffled."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    n = ids.count()
    return table.join(lookup(ids, n), "node", "left_semi") if n <= BROADCAST_ROWS else table


def _rarest(own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Lists (value, node, label, size) of the nodes' rarest shingles that are not one component's: a partner shares percent of a node's whole set, so it shares one of the rarest others plus one."""
    posts = own.join(sets, "node").select("node", "label", "size", F.explode("set").alias("value"))
    times = posts.groupBy("value").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("df > 1")
    shared = written(posts.join(times, "value"), "shared-shingles")
    spare = F.col("size") - F.floor((F.col("size") * percent + 99) / 100)
    alive = shared.groupBy("node").agg(F.count("*").alias("c"), F.first("size").alias("n")).where(F.col("n") - F.col("c") <= F.col("n") - F.floor((F.col("n") * percent + 99) / 100)).select("node", "c")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "value"))
    listed = shared.join(alive, "node").withColumn("r", rank + F.col("size") - F.col("c")).where(F.col("r") <= spare + 1)
    return listed.where("lo <> hi").select("value", "node", "label", "size")


def node_components(docs: DataFrame, found: DataFrame, n: int, percent: int, k: int = SKETCH, block: int = BLOCK) -> DataFrame:
    """(node, label) for the nodes that have links; found: written sketches of docs."""
    whole = found.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "row", "n_shingles", "sketch")).alias("r"))
    full = written(whole.select("node", "r.row", "r.n_shingles", "r.sketch"), "all-nodes")
    posts = full.select("node", F.explode("sketch").alias("value"))
    times = posts.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = written(posts.join(times, "value"), "shared-values")
    kept = F.greatest(F.lit(1), F.floor(F.size("sketch") * F.lit(LEAST)))
    least = full.select("node", "n_shingles", F.size("sketch").alias("m"), kept.alias("kept"))
    counted = shared.groupBy("node").agg(F.count("*").alias("c"), F.sum("df").alias("central"))
    # nodes with too few shared values cannot have a partner
    alive = counted.join(least, "node").where("c >= kept")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "value"))
    # of m values, m - c are unshared and rarest; the first m - kept + 1 are listed
    lists = shared.join(alive, "node").withColumn("r", rank + F.col("m") - F.col("c")).where(F.col("r") <= F.col("m") - F.col("kept") + 1)
    lists = written(lists.select("value", "node", F.col("n_shingles").alias("size"), (F.col("central") / F.col("m")).alias("score")), "lists")
    discard(shared)
    nodes = written(full.join(lists.select("node").distinct(), "node", "left_semi"), "nodes")
    discard(full)
    sets = written(_full_sets(docs, lookup(nodes.select("node", "row"), nodes.count()), n), "full-sets")
    labels = list_components(lists, lambda pairs: _confirmed(pairs, nodes, sets, percent, k), percent, sets.select("node", "bits"), lambda own: _rarest(own, sets, percent), block)
    for t in (lists, sets, nodes):
        discard(t)
    return labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, k: int = SKETCH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row for every row of docs (doc_id, text); percent: least similarity."""
    found = written(sketches(docs, n, k), "sketches")
    labels = node_components(docs, found, n, percent, k, block)
    slim = found.select("doc_id", "row", "n_shingles", "node")
    named = written(slim.where("n_shingles > 0").join(labels, "node", "left").select("doc_id", "row", "n_shingles", F.coalesce("label", "node").alias("label")), "named")
    # of its own, so that the join can split a large component's rows
    least = written(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least-ids")
    out = named.join(least, "label").select("doc_id", "n_shingles", "component_id", "row", "label")
    empty = slim.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", F.lit(None).cast("binary").alias("label"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the least id, then hash of id and text; of rows equal in both, one. Rows without words all stay.

    Most rows stay, so those that may not are looked up: no text is shuffled but theirs, and those that a filter of their hashes takes for theirs.
    """
    found = written(near_duplicates(docs, n, percent), "components").where("label is not null")
    one = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k")).select(F.col("k.row").alias("_row"), F.lit(True).alias("_stays"))
    times = found.groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("_times"))
    # rows that go, and rows of which one stays; all others stay
    asked = written(times.join(one, "_row", "left").where("_stays IS NULL OR _times > 1").select("_row", F.col("_stays").isNotNull().alias("_stays")), "open-rows")
    copies = written(asked.where("_stays").select("_row"), "copies")
    n_asked, n_copies = asked.count(), copies.count()
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), row_hash("doc_id", "text").alias("_row"))
    if n_asked <= BROADCAST_ROWS:
        left = whole.join(lookup(asked, n_asked), "_row", "left_anti")
    else:
        whole, sure = filtered(whole, asked, "_row")
        left = sure.unionByName(whole.join(asked, "_row", "left_anti"))
    if n_copies:
        left = left.unionByName(whole.join(lookup(copies, n_copies), "_row", "left_semi").dropDuplicates(["_row"]))
    return left.select("_doc.*")
