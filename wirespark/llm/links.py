"""Connected components of links, and of links that inverted lists hold: hooking to the least label plus pointer jumping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespark.llm.common import discard, written

#: Lists of more nodes are dealt into blocks of about as many, and each two blocks meet in a task's step of their own.
BLOCK = 4096
#: Partners that a node is given in a list before components are merged.
FEW = 2


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the least node of its component. Nothing is collected but a count a round."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = written(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(hooked.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        discard(labels)
        discard(hooked)
        labels = new.drop("old")
        if not changed:
            discard(both)
            return labels


def list_components(lists: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int, marks: DataFrame | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """(node, label) of linked nodes, from written inverted lists (value, node, size, score); confirm: keeps the true links of pairs (a, b).

    First every node of a list meets the list's most central node, that of the highest score. Then the nodes of lists that
    hold several components meet: each a FEW of those that sizes and marks allow and that are of other components, and,
    once what these links join has been merged, all of them. Sizes allow a pair if the lesser is `percent` of the greater.
    marks (node, bits): bitmaps of sets, see Bitmaps.
    narrow: from the nodes (node, label, size) of lists of more than `block` nodes to lists (value, node, label, size) that
    hold every true link among them. No pair that is ruled out leaves the step that compares it, and no list is capped.
    """
    near = (F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * percent)
    firsts = lists.groupBy("value").agg(F.max(F.struct("score", "node", "size")).alias("f")).select("value", F.col("f.node").alias("x"), F.col("f.size").alias("n_a"))
    star = lists.select("value", F.col("node").alias("y"), F.col("size").alias("n_b")).join(firsts, "value").where((F.col("x") != F.col("y")) & near)
    links = written(confirm(_ordered(star.select("x", "y"))), "star-links")
    labels = components(links)
    rows = _narrowed(_open(lists, labels), narrow, block)
    links = _joined(links, written(confirm(_ordered(_meet(rows, percent, marks, block, FEW))), "first-links"))
    rows, done = _open(rows, components(links)), rows
    discard(done)
    more = written(confirm(_ordered(_meet(rows, percent, marks, block, None))), "cross-links")
    links = _joined(links, more)
    labels = components(links)
    for t in (rows, links):
        discard(t)
    return labels


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _joined(one: DataFrame, two: DataFrame) -> DataFrame:
    both = written(one.unionByName(two), "links")
    for t in (one, two):
        discard(t)
    return both


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold several components, written: (value, node, size, label, n), a node's own name where it has no links; n: the list's nodes."""
    named = lists.select("value", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    return written(named.join(counts.select("value", "n"), "value"), "open-lists")


def _narrowed(rows: DataFrame, narrow: Callable[[DataFrame], DataFrame] | None, block: int) -> DataFrame:
    hot = rows.where(F.col("n") > block)
    if narrow is None or not hot.limit(1).count():
        return rows
    lists = written(narrow(written(hot.select("node", "label", "size").distinct(), "hot-nodes")), "narrow-lists")
    lists = lists.join(lists.groupBy("value").agg(F.count("*").alias("n")), "value")
    out = written(rows.where(F.col("n") <= block).unionByName(lists.select(*rows.columns)), "open-lists")
    discard(rows)
    return out


def _meet(rows: DataFrame, percent: int, marks: DataFrame | None, block: int, few: int | None) -> DataFrame:
    """Pairs (x, y) of one list and two components that sizes and marks allow; few: at most so many for each x and list."""
    kind = rows.schema["node"].dataType.simpleString()
    blocks = F.ceil(F.col("n") / block)
    side = F.pmod(F.xxhash64("node", "value"), blocks)
    dealt = rows.select("value", "node", "size", "label", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"), blocks.alias("blocks"))
    cell: Column = F.least("side", "other") * F.col("blocks") + F.greatest("side", "other")
    dealt = dealt.select("value", cell.alias("cell"), "node", "size", "label", F.when(F.col("side") != F.col("other"), F.col("side")).otherwise(-1).alias("side"), (F.col("side") == F.col("other")).alias("own"))
    # a block meets itself in its own cell; in a cell of two blocks only nodes of different sides meet
    dealt = dealt.withColumn("bits", F.lit(None).cast("array<long>")) if marks is None else dealt.join(marks, "node")
    dealt = dealt.select("value", "cell", "node", "size", "label", "side", "bits").repartition("value", "cell").sortWithinPartitions("value", "cell", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            nodes = table.column("node").combine_chunks()
            for p, q in _pairs(table, percent, few):
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(p)), nodes.take(pa.array(q))], ["x", "y"])

    return dealt.mapInArrow(run, f"x {kind}, y {kind}")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each (value, cell) they hold; rows come in that order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value, cell = (np.asarray(batch.column(c)) for c in ("value", "cell"))
        cut = int(np.flatnonzero((value != value[-1]) | (cell != cell[-1]))[-1]) + 1 if (value[0], cell[0]) != (value[-1], cell[-1]) else 0
        if held and (held[-1].column("value")[-1].as_py(), held[-1].column("cell")[-1].as_py()) != (value[0], cell[0]) and not cut:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(table: pa.Table, percent: int, few: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of each cell that may be links: each row is compared with the k-th one after it, for all rows at once and growing k, as long as sizes, which ascend in a cell, allow it."""
    value, cell, size, side = (table.column(c).to_numpy() for c in ("value", "cell", "size", "side"))
    label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    bitmaps = Bitmaps(table.column("bits").combine_chunks())
    found = np.zeros(len(value), np.int64)
    p, k = np.arange(len(value)), 0
    while len(p):
        k += 1
        p = p[p + k < len(value)]
        q = p + k
        go_on = (value[p] == value[q]) & (cell[p] == cell[q]) & (size[p] * 100 >= size[q] * percent)
        p = p[go_on] if few is None else p[go_on & (found[p] < few)]
        q = p + k
        asked = (label[p] != label[q]) & ((side[p] < 0) | (side[p] != side[q]))
        a, b = p[asked], q[asked]
        if bitmaps.some and len(a):
            good = bitmaps.within(a, b, (size[a] + size[b]) * (100 - percent) // (100 + percent))
            a, b = a[good], b[good]
        if len(a):
            found[a] += 1
            yield a, b


class Bitmaps:
    """Bitmaps whose numbers of bits are powers of two: bit h mod size for each hash h of a set; folded in half, one is that of half the size."""

    def __init__(self, bits: pa.Array):
        self.some = len(bits) > 0 and bits.null_count < len(bits)
        if not self.some:
            return
        offsets, words = np.asarray(bits.offsets).astype(np.int64), np.asarray(bits.values).view(np.uint64)
        self.width, self.at, self.wide, self.narrow = np.diff(offsets), {}, {}, {}
        for w in np.unique(self.width).tolist():
            own, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            self.wide[w] = np.concatenate([words[offsets[own][:, None] + np.arange(w)], folded(words[offsets[twice][:, None] + np.arange(2 * w)], w)])
            self.narrow[w] = folded(self.wide[w], w // DENSE)
            self.at[w] = np.zeros(len(self.width), np.int64)
            self.at[w][np.concatenate([own, twice])] = np.arange(len(own) + len(twice))

    def within(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which bitmaps at a and b, folded to the lesser size, differ in at most so many bits; the sets differ in as many elements at least. Sizes more than twice apart: all."""
        less, more = np.minimum(self.width[a], self.width[b]), np.maximum(self.width[a], self.width[b])
        good = np.ones(len(a), bool)
        for w in self.wide:
            rows = np.flatnonzero((less == w) & (more <= 2 * w))
            for maps in (self.narrow[w], self.wide[w]):  # what the narrow ones rule out needn't be looked at closely
                kept = []
                for part in np.array_split(rows, max(1, len(rows) * maps.shape[1] >> 20)):
                    far = np.bitwise_count(maps[self.at[w][a[part]]] ^ maps[self.at[w][b[part]]]).sum(axis=1, dtype=np.int64)
                    good[part] = far <= most[part]
                    kept.append(part[good[part]])
                rows = np.concatenate(kept)
        return good


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


#: Bits of a bitmap for each element, rounded up to a power of two; the most words.
DENSE, MOST_WORDS = 8, 1024


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The bitmap of a set of 64-bit hashes as 64-bit words."""
    size = min(max(512, DENSE << max(0, len(hashes) - 1).bit_length()), 64 * MOST_WORDS)
    bits = np.zeros(size, np.uint8)
    bits[((hashes >> np.uint64(7)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)
