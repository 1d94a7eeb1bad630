"""Subword lattice likelihood: the marginal probability of a text over all segmentations into an existing vocabulary.

The pieces and their order come from a public vocabulary, never trained here; their unigram probabilities start from
that order (a piece of rank r weighs 1 / (r + 2)) and are fitted to the training words by expectation-maximisation over
all segmentations, on every distinct training word with its count. A piece never crosses white space, so a text's
probability is the product of its words' (each opened by the vocabulary's space mark) and the end's; a word's is found by
the forward recursion in log space, for many words at once, column by column. Characters without a piece fall back to
bytes, which share one probability.

Scoring: words of the training table that are frequent (a bounded number of them) are broadcast with their counts; the
others are joined to the table by shuffle for the base score, so every count is exact. Lattice scores need no join.

A null text counts as empty; an empty text is its end alone. Null ids hash as the empty string. Equal rows are scored
each. An empty table gives an empty result; without training rows all counts are 0. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm.common import coded, lowered, mix64, per_text, slices, split_words, texts_of, written

SPACE = "▁"
CHUNK_BYTES, BLOCK_CHARS = 16 << 20, 1 << 18
FREQUENT = 400_000
ROUNDS, PRIOR = 3, 0.01
STEP = np.uint64(0x100000001B3)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model in order, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


@dataclass
class Model:
    """Natural-log probabilities of the pieces, of any one byte, and of the end."""

    pieces: list[str]
    scores: np.ndarray
    byte: float
    end: float

    def __post_init__(self):
        prefixes: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            for k in range(1, len(piece)):
                prefixes.setdefault(piece[:k], -1)
            prefixes[piece] = i
        hashes = np.array([_hash(p) for p in prefixes], np.uint64)
        order = np.argsort(hashes)
        self._table, self._which = hashes[order], np.array(list(prefixes.values()), np.int64)[order]
        self._longest = max(map(len, self.pieces), default=1)

    def _edges(self, codes: np.ndarray, sizes: np.ndarray):
        """Edges of words sorted by falling size: (word, start node, end node, piece); piece -k: a character of k bytes. Nodes are laid out by place, then word."""
        most = int(sizes[0])
        chars_at = np.searchsorted(-sizes, -np.arange(most + 1), side="left")  # words longer than t
        nodes_at = np.concatenate([[len(sizes)], chars_at[:-1]])  # words of t characters or more
        col, ncol = np.concatenate([[0], np.cumsum(chars_at)]), np.concatenate([[0], np.cumsum(nodes_at)])
        t = np.repeat(np.arange(most), chars_at[:most])
        w = np.arange(len(t)) - col[t]
        rows = np.concatenate([[0], np.cumsum(sizes)])
        c = codes[rows[w] + t].astype(np.uint64)
        h, found = np.zeros(len(t), np.uint64), []
        first_w, first_t = w, t
        for size in range(1, self._longest + 1):
            at = t + size - 1
            if size > 1:
                ok = at < sizes[w]
                w, t, h, at = w[ok], t[ok], h[ok], at[ok]
            h = mix64(h * STEP + c[col[at] + w] + np.uint64(1))
            k = np.minimum(np.searchsorted(self._table, h), len(self._table) - 1)
            hit = self._table[k] == h
            piece = np.where(hit, self._which[k], -1)
            full = piece >= 0
            found.append((w[full], t[full], t[full] + size, piece[full]))
            if size == 1 and not full.all():
                x = c[~full]
                n_bytes = 1 + (x > 0x7F).astype(np.int64) + (x > 0x7FF) + (x > 0xFFFF)
                found.append((first_w[~full], first_t[~full], first_t[~full] + 1, -n_bytes))
            w, t, h = w[hit], t[hit], h[hit]
            if not len(w):
                break
        w, t, to, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return w, ncol[t] + w, ncol[to] + w, piece, ncol

    def _costs(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.scores[np.maximum(piece, 0)], -piece * self.byte)

    def words(self, words: pa.Array) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for rows, codes, sizes in _blocks(words):
            w, a, b, piece, ncol = self._edges(codes, sizes)
            order = np.argsort(b, kind="stable")
            up = _sweep(a[order], b[order], self._costs(piece[order]), ncol, range(1, len(ncol) - 1))
            out[rows] = up[ncol[sizes] + np.arange(len(sizes))]
        return out

    def expected(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of each piece, and of bytes, over all segmentations of words that occur counts times."""
        total, n_bytes = np.zeros(len(self.pieces)), 0.0
        for rows, codes, sizes in _blocks(words):
            w, a, b, piece, ncol = self._edges(codes, sizes)
            cost = self._costs(piece)
            order = np.argsort(b, kind="stable")
            up = _sweep(a[order], b[order], cost[order], ncol, range(1, len(ncol) - 1))
            ends = ncol[sizes] + np.arange(len(sizes))
            order = np.argsort(a, kind="stable")
            down = _sweep(b[order], a[order], cost[order], ncol, range(len(ncol) - 3, -1, -1), ends)
            share = np.exp(up[a] + cost + down[b] - up[ends][w]) * counts[rows][w]
            real = piece >= 0
            total += np.bincount(piece[real], share[real], len(self.pieces))
            n_bytes += float((-piece[~real] * share[~real]).sum())
        return total, n_bytes


def _hash(text: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for ch in text:
        h = mix64(h * STEP + np.uint64(ord(ch) + 1))
    return h[0]


def _blocks(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, code points with the space mark before each word, sizes) of words by falling size, in bounded blocks."""
    if not len(words):
        return
    sizes = np.asarray(pc.utf8_length(words)).astype(np.int64) + 1
    order = np.argsort(-sizes, kind="stable")
    ends, a = np.cumsum(sizes[order]), 0
    while a < len(order):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + BLOCK_CHARS, side="right")))
        rows = order[a:b]
        text = SPACE + SPACE.join(words.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(text.encode("utf-32-le"), "<u4"), sizes[rows]
        a = b


def _sweep(near: np.ndarray, far: np.ndarray, cost: np.ndarray, ncol: np.ndarray, columns: range, ends: np.ndarray | None = None) -> np.ndarray:
    """Log sums over paths, column by column: far nodes get theirs from near ones. Edges are sorted by far."""
    out = np.full(ncol[-1], -np.inf)
    out[: ncol[1]] = 0.0
    if ends is not None:
        out[:] = -np.inf
        out[ends] = 0.0
    cuts = np.searchsorted(far, ncol)
    for t in columns:
        a, b = cuts[t], cuts[t + 1]
        if a == b:
            continue
        v, to = out[near[a:b]] + cost[a:b], far[a:b]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        top = np.maximum.reduceat(v, first)
        safe = np.where(np.isfinite(top), top, 0.0)
        size = np.diff(np.append(first, len(v)))
        with np.errstate(divide="ignore"):
            out[to[first]] = safe + np.log(np.add.reduceat(np.exp(v - np.repeat(safe, size)), first))
    return out


def training(key: Column) -> Column:
    """Whether a document is learned from: the remainder of its id's crc32 by 5 isn't 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over docs, lower-cased in ASCII; each chunk's counts are combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, CHUNK_BYTES):
            words, _ = split_words(lowered(texts_of(batch.column(text_col))))
            codes, distinct = coded(words)
            counts = np.bincount(codes, minlength=len(distinct))
            for a in range(0, len(distinct), 20_000):
                yield pa.RecordBatch.from_arrays([distinct.slice(a, 20_000).cast(pa.string()), pa.array(counts[a : a + 20_000])], ["word", "c"])

    return docs.select(text_col).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(table: DataFrame, n_docs: int, path: str | None = None, rounds: int = ROUNDS) -> Model:
    """The vocabulary's probabilities after some rounds over the whole word table; a round collects one number a piece."""
    pieces = vocabulary(path or default_path())
    weight = 1.0 / (np.arange(len(pieces)) + 2)
    model = _model(pieces, weight, weight.sum() * 1e-4, weight.sum() * 1e-3)
    for _ in range(rounds if n_docs else 0):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total, n_bytes = np.zeros(len(model.pieces)), 0.0
            for batch in batches:
                t, n = model.expected(batch.column("word").cast(pa.large_string()), np.asarray(batch.column("c")).astype(float))
                total, n_bytes = total + t, n_bytes + n
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n_bytes))], ["piece", "n"])

        got = dict(map(tuple, table.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect()))
        n_bytes = got.pop(-1, 0.0)
        weight = np.zeros(len(pieces))
        weight[np.array(list(got), np.int64)] = list(got.values())
        model = _model(pieces, weight + PRIOR, n_bytes + 256 * PRIOR, n_docs + PRIOR)
    return model


def _model(pieces: list[str], weight: np.ndarray, n_bytes: float, ends: float) -> Model:
    total = weight.sum() + n_bytes + ends
    return Model(pieces, np.log(weight / total), math.log(n_bytes / 256 / total), math.log(ends / total))


def frequent(table: DataFrame, most: int = FREQUENT) -> list[tuple[str, int]]:
    """The words whose counts are above a threshold that at most `most` words exceed, without very long words."""
    above, least = 0, None
    short = table.where(F.octet_length("word") <= 64)
    # counts by their binary logarithm and next 3 bits: some hundred classes, whatever the table's size
    log = F.floor(F.log2(F.col("c").cast("double")) * 8)
    for k, n in sorted(map(tuple, short.groupBy(log.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if above + n > most:
            break
        above, least = above + n, k
    return [] if least is None else [tuple(r) for r in short.where(log >= least).collect()]


def scored(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, most: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    learned = docs.where(training(F.col("doc_id")))
    table = written(word_counts(learned), "word-counts")
    n_docs = learned.select("doc_id").count()
    r = table.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, kinds = (r["n"] or 0) + n_docs, r["v"] + (n_docs > 0)
    model = fit(table, n_docs, path, rounds)
    often = frequent(table, most)
    names = pa.array([w for w, _ in often], pa.large_string())
    known = spark.sparkContext.broadcast((names, np.log10(np.array([c for _, c in often], float) + 0.5), model.words(names), model))
    end = math.log10(n_docs + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base_of, score_of, model = known.value
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", CHUNK_BYTES // 2):
            words, at = split_words(lowered(texts_of(batch.column("text"))))
            codes, distinct = coded(words)
            distinct = distinct.cast(pa.large_string())
            which = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=names), -1)).astype(np.int64)
            rare = np.flatnonzero(which < 0)
            base, score = np.zeros(len(distinct)), np.zeros(len(distinct))
            base[which >= 0], score[which >= 0] = base_of[which[which >= 0]], score_of[which[which >= 0]]
            score[rare] = model.words(distinct.take(pa.array(rare)))
            unseen = (which < 0)[codes]
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[unseen]
            pairs, times = np.unique(doc * max(len(distinct), 1) + codes[unseen], return_counts=True)
            owner, word = np.divmod(pairs, max(len(distinct), 1))
            offsets = np.searchsorted(owner, np.arange(len(at))).astype(np.int32)
            items = pa.StructArray.from_arrays([distinct.take(pa.array(word)).cast(pa.string()), pa.array(times)], ["word", "k"])
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(len(n))), batch.column("doc_id"), batch.column("held_out"), pa.array(n + 1), pa.array(per_text((~unseen).astype(np.int64), at)),
                    pa.array(per_text(base[codes], at)), pa.array((per_text(score[codes], at) + model.end) / math.log(10)), pa.ListArray.from_arrays(pa.array(offsets), items),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"],
            )
            row += len(n)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<word:string,k:long>>"
    parts = written(docs.select("doc_id", "text", (~training(F.col("doc_id"))).alias("held_out")).mapInArrow(run, schema), "scored")
    rest = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k").join(table, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rest.groupBy("row").agg(F.sum(F.col("k") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more_known"))
    out = parts.drop("rare").join(sums, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(math.log10(n_all + 0.5 * (kinds + 1)))
    n_known = F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_docs > 0))
    return out.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
