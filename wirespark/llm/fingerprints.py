"""Document fingerprints by randomised edit embedding.

All texts share one random walk rule: at step j the walk stands on a character and moves on by one or not at all, by a
random bit of (j, character). An embedded text is what the walk sees over 3 n steps for n characters; texts that differ by
few edits fall back into step after each, so edit distance becomes Hamming distance. A fingerprint samples SAMPLES steps:
those of least random priority among the 3 n, so texts of like length share nearly all of them. A sample is a byte of the
characters at the walk's place, or 0 behind the end. The likeness of two fingerprints is the part of equal samples among
the steps sampled for the longer text where not both are behind their end.

The walks of all texts of a chunk go in step, one vector operation for each step. near_duplicates() bands the samples,
pairs within bands, and verifies pairs by the likeness of whole fingerprints. A length's samples differ from the next
length's by one step at most, and a step takes the place of the one that it displaces, so that each change touches one
band. A text has the bands of its own length and, for every greater length at which its likeness can still reach the
threshold, those that its text has there, behind whose end all samples are 0: a pair meets in the bands of its longer text.
Likeness counts samples of just these steps, so at a threshold of 0.8 unequal samples are fewer than bands and one band is
equal throughout, whatever the lengths; only bands with fewer than LEAST_SEEN samples before the end are left out.

Null texts count as empty; two empty texts have likeness 1, an empty and another 0. Null ids come last in descending order; rows
equal in id follow each other by their texts' hashes. Equal texts have equal fingerprints. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespark.llm.common import mix64, partitions_for, slices, texts_of, written
from wirespark.llm.links import list_components

SAMPLES, GRAM, PERIOD, SEED = 96, 6, 4096, 7
CHUNK_BYTES, PARTITION_BYTES = 8 << 20, 16 << 20
SHRINK = 128
BAND_STEPS, LEAST_SEEN = 4, 2
BANDS = SAMPLES // BAND_STEPS
#: A pair's lengths may differ by this part of the threshold.
LEAST_SIZE = 0.5
SCHEMA = "kind string, part long, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _moves() -> np.ndarray:
    """A random bit for each step (repeating) and character class; class 0, the end, never moves."""
    bits = mix64(np.arange(PERIOD * 256, dtype=np.uint64) + np.uint64(SEED << 32)) >> np.uint64(63)
    moves = bits.astype(np.uint8).reshape(PERIOD, 256)
    moves[:, 0] = 0
    return moves


MOVES = _moves()


class Steps:
    """The steps that some length samples: at its turn such a step is among the SAMPLES of least priority so far."""

    _known = 0
    steps = np.zeros(0, np.int64)
    priority = np.zeros(0, np.uint64)

    @classmethod
    def upto(cls, size: int) -> None:
        while cls._known < size:
            more = np.arange(cls._known, cls._known + min(max(cls._known, 1 << 16), 1 << 24), dtype=np.int64)
            prio = mix64(more.astype(np.uint64) + np.uint64((SEED + 1) << 40))
            if len(cls.steps) >= SAMPLES:  # later steps must beat the best so far
                bar = np.partition(cls.priority, SAMPLES - 1)[SAMPLES - 1]
                more, prio = more[prio < bar], prio[prio < bar]
            top, keep = [-p for p in np.sort(cls.priority)[:SAMPLES].tolist()], []
            heapq.heapify(top)
            for p in prio.tolist():
                keep.append(len(top) < SAMPLES or p < -top[0])
                if len(top) < SAMPLES:
                    heapq.heappush(top, -p)
                elif keep[-1]:
                    heapq.heapreplace(top, -p)
            cls.steps, cls.priority = np.append(cls.steps, more[keep]), np.append(cls.priority, prio[keep])
            cls._known += min(max(cls._known, 1 << 16), 1 << 24)

    @classmethod
    def of(cls, n_chars: int) -> np.ndarray:
        """Places in `steps` of the samples of a text of n characters, by step."""
        cls.upto(3 * n_chars)
        inside = int(np.searchsorted(cls.steps, 3 * n_chars))
        if inside <= SAMPLES:
            return np.arange(inside)
        return np.sort(np.argpartition(cls.priority[:inside], SAMPLES - 1)[:SAMPLES])


def fingerprints(texts: list[str]) -> list[str]:
    """A fingerprint of each text: its length and its samples, in hexadecimal."""
    sizes = np.array([len(t) for t in texts], np.int64)
    Steps.upto(3 * int(sizes.max(initial=0)))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), "<u4").copy()
    ends = starts + sizes
    kinds = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    np.maximum(kinds, 1, out=kinds)
    kinds[ends] = 0
    gram = np.zeros(len(codes), np.uint32)
    for k in range(GRAM):
        shifted = codes[k:] if k else codes
        gram[: len(shifted)] = gram[: len(shifted)] * np.uint32(0x01000193) + shifted
    for k in range(1, GRAM):  # a window that reaches the text's end sees zeros behind it
        at = (ends - k)[ends - k >= starts]
        h = np.zeros(len(at), np.uint32)
        for j in range(GRAM):
            h = h * np.uint32(0x01000193) + (codes[at + j] if j < k else np.uint32(0))
        gram[at] = h
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x2C1B3C6D)
    seen = np.maximum(gram >> np.uint32(24), 1).astype(np.uint8)
    seen[ends] = 0
    del gram, codes
    values = np.zeros((len(Steps.steps), len(texts)), np.uint8)
    who, place = np.flatnonzero(sizes > 0), starts[sizes > 0].copy()
    due = 0
    turns = Steps.steps.tolist()
    step, last = 0, 3 * int(sizes.max(initial=0))
    while len(who) and step < last:
        stop = min(step + SHRINK, last)
        while step < stop:
            if due < len(turns) and turns[due] == step:
                values[due, who] = seen[place]
                due += 1
            place += MOVES[step % PERIOD][kinds[place]]
            step += 1
        alive = kinds[place] > 0
        if not alive.all():
            who, place = who[alive], place[alive]
    out = []
    for i, n in enumerate(sizes.tolist()):
        out.append(f"{n:x}:" + values[Steps.of(n), i].tobytes().hex())
    return out


def samples(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(length, places in Steps, values)."""
    n, _, values = fingerprint.partition(":")
    return int(n, 16), Steps.of(int(n, 16)), np.frombuffer(bytes.fromhex(values), np.uint8)


def likeness(one: str, two: str) -> float:
    """0 to 1."""
    if one == two:
        return 1.0
    (n, at, own), (m, to, other) = samples(one), samples(two)
    if n < m:
        n, at, own, m, to, other = m, to, other, n, at, own
    if not m:
        return 0.0
    k = np.minimum(np.searchsorted(to, at), len(to) - 1)
    theirs = np.where(to[k] == at, other[k], 0)  # a step of the longer text that the shorter one lacks is behind its end
    asked = (own > 0) | (theirs > 0)
    return float((own == theirs)[asked].mean()) if asked.any() else 0.0


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as many first characters of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _row(text: str, changed: str, own: str, new: str, following: str) -> tuple:
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), own, new, likeness(own, new), likeness(own, following)


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs (doc_id, text), where the next document is that of the next lower id, after the last the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, None
        for batch in slices(batches, "text", CHUNK_BYTES):
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text")).to_pylist()
            own = fingerprints(texts)
            if first is None:
                first = (ids[0], texts[0])
            if held is not None:
                ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
            held = (ids[-1], texts[-1], own[-1])
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            new = fingerprints(changed) if changed else []
            rows = [("row", part, i, None, *_row(t, c, f, g, h)) for i, t, c, f, g, h in zip(ids, texts, changed, own, new, own[1:], strict=False)]
            if rows:
                yield _batch(rows)
        if held is not None:
            yield _batch([("head", part, *first, *[None] * 6), ("tail", part, held[0], held[1], *[None] * 6)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            ids, texts, after = batch.column("doc_id").to_pylist(), texts_of(batch.column("text")).to_pylist(), texts_of(batch.column("after")).to_pylist()
            changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
            marks = zip(ids, texts, changed, fingerprints(texts), fingerprints(changed), fingerprints(after), strict=True)
            yield _batch([("row", 0, i, None, *_row(t, c, f, g, h)) for i, t, c, f, g, h in marks])

    spark, by = docs.sparkSession, F.col("doc_id").desc_nulls_last()
    dealt = docs.select("doc_id", "text").repartitionByRange(partitions_for(docs, "text", PARTITION_BYTES), by).sortWithinPartitions(by, F.xxhash64("text"))
    found = written(dealt.mapInArrow(run, SCHEMA), "walks")
    parts = sorted(r[0] for r in found.where("kind = 'head'").select("part").collect())  # one number a partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, next long")
    heads = found.where("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    edges = found.where("kind = 'tail'").select("part", "doc_id", "text").join(after, "part").join(heads, "next").select("doc_id", "text", "after")
    rows = found.where("kind = 'row'").unionByName(edges.mapInArrow(finish, SCHEMA))
    return rows.drop("kind", "part", "text")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class Bands:
    """The bands of all lengths up to one: `places` in Steps of each version of a band (-1: none), the versions in force from each `start` on, and of the steps in force those that every walk of that many characters lasts for."""

    _known = 0
    places = np.zeros((0, BAND_STEPS), np.int64)
    starts = np.zeros(0, np.int64)
    versions = np.zeros((0, BANDS), np.int64)
    lasting = np.zeros(0, np.int64)

    @classmethod
    def upto(cls, size: int) -> None:
        if size <= cls._known:
            return
        cls._known = max(2 * cls._known, size, 1 << 14)
        Steps.upto(3 * cls._known)
        held, queue, places, starts, versions = np.full(SAMPLES, -1), [], [np.full(BAND_STEPS, -1)], [0], [[0] * BANDS]
        for k, (step, prio) in enumerate(zip(Steps.steps.tolist(), Steps.priority.tolist(), strict=True)):
            slot = k if k < SAMPLES else heapq.heappop(queue)[1]
            heapq.heappush(queue, (-prio, slot))
            held[slot] = k
            band, start = slot // BAND_STEPS, step // 3 + 1
            if start != starts[-1]:
                starts.append(start)
                versions.append(list(versions[-1]))
            versions[-1][band] = len(places)
            places.append(np.sort(held[band * BAND_STEPS : (band + 1) * BAND_STEPS]))
        cls.places, cls.starts, cls.versions = np.array(places), np.array(starts), np.array(versions)
        # about 2 n steps; less six standard errors and the unevenness of a period's random bits
        short = 1.95 * cls.starts - 9 * np.sqrt(cls.starts)
        at = np.append(Steps.steps, np.iinfo(np.int64).max)[cls.places[cls.versions].reshape(len(starts), -1)]
        cls.lasting = (at < short[:, None]).sum(axis=1)


def bands(fingerprint: str, least: float = 0.8) -> list[int]:
    """Keys of the bands of a fingerprint, for its own length and all greater ones of texts whose likeness to it may be `least`."""
    n, at, values = samples(fingerprint)
    if not n:
        return []
    top = int(n / (LEAST_SIZE * least))
    Bands.upto(top)
    own = np.zeros(len(Steps.steps) + 1, np.uint8)
    own[at] = values
    first, stop = np.searchsorted(Bands.starts, [n, top], "right")
    ids = Bands.versions[first - 1 : stop]
    some = np.unique(ids)
    seen = (own[Bands.places[some]] > 0).sum(axis=1)
    total = seen[np.searchsorted(some, ids)].sum(axis=1)
    reached = total >= least * Bands.lasting[first - 1 : stop]
    reached[0] = True
    asked = np.unique(ids[reached])
    asked = asked[seen[np.searchsorted(some, asked)] >= LEAST_SEEN]
    h = asked.astype(np.uint64)
    for k in range(BAND_STEPS):
        h = mix64(h * np.uint64(257) + own[Bands.places[asked, k]])
    return h.view(np.int64).tolist()


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, n_chars, fingerprint, class_id) of docs (doc_id, text): texts whose fingerprints chain by bands and a likeness of at least `least` share a class. Texts of equal fingerprint are one node."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = texts_of(batch.column("text")).to_pylist()
            found = fingerprints(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(found), pa.array([bands(f, least) for f in found], pa.list_(pa.int64()))], ["doc_id", "n_chars", "fingerprint", "bands"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [likeness(a, b) >= least for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    marked = written(docs.select("doc_id", "text").mapInArrow(mark, "doc_id long, n_chars long, fingerprint string, bands array<long>"), "marked")
    nodes = marked.where("n_chars > 0").select(F.col("fingerprint").alias("node"), F.col("n_chars").alias("size"), "bands").dropDuplicates(["node"])
    lists = nodes.select(F.explode("bands").alias("value"), "node", "size", F.lit(0.0).alias("score"))
    shared = lists.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    lists = written(lists.join(shared, "value"), "bands")
    labels = list_components(lists, lambda pairs: pairs.select("a", "b").mapInArrow(verify, "a string, b string"), int(100 * LEAST_SIZE * least))
    named = marked.drop("bands").join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    named = written(named, "fingerprint-classes")
    return named.join(named.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("doc_id", "n_chars", "fingerprint", "class_id")
