"""Token ids in wavelet matrices, one compressed file a shard.

Documents are dealt to shards by ranges of doc_id and tokenised whole, with an end id. A shard's ids become a wavelet
matrix: plane k holds bit k of all ids, the highest first, in an order that each plane partitions stably into zeros and
ones. The planes are cut into blocks, compressed one by one; a directory holds each block's place and the number of ones
before it. So access(i), rank(id, i), count(id) and select(id, j) read one block a plane from the file, and decoding reads
all of it once.

File: magic, little-endian header length, JSON header (sizes, planes, documents' sections), sections, blocks. The
sections are compressed arrays: doc ids and where each document starts, block places, ones before blocks, zeros a plane.

A task writes its file under an attempt's own name and renames it; a second attempt writes the same bytes. Null texts count as empty
(their end id alone). Null ids come first; rows equal in id follow each other by their texts' hashes. Nothing but a row a shard (its
name and sizes) reaches the driver. An empty table writes no file. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm.common import partitions_for, shared_dir, slices, texts_of
from wirespark.llm.tokens import WordEncoder, default_path

MAGIC = b"WAVELET1"
BLOCK_BITS = 1 << 18
SHARD_BYTES = 16 << 20
NULL_ID = -(1 << 63)


def build(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A file's bytes. starts: one longer than doc_ids."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    order, bodies, ones, zeros, at = ids.astype(np.uint32), [], [], [], 0
    pack, places = zstandard.ZstdCompressor(level=1), [0]
    for k in range(planes - 1, -1, -1):
        bit = (order >> np.uint32(k) & np.uint32(1)).astype(bool)
        before = 0
        for a in range(0, max(len(bit), 1), BLOCK_BITS):
            part = bit[a : a + BLOCK_BITS]
            bodies.append(pack.compress(np.packbits(part).tobytes()))
            ones.append(before)
            at += len(bodies[-1])
            places.append(at)
            before += int(part.sum())
        zeros.append(len(bit) - before)
        order = np.concatenate([order[~bit], order[bit]])
    arrays = [np.asarray(a, "<i8") for a in (doc_ids, starts, places, ones, zeros)]
    sections = [pack.compress(a.tobytes()) for a in arrays]
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "planes": planes, "block_bits": BLOCK_BITS, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections, *bodies])


class WaveletFile:
    """One shard, read from a seekable binary file as far as needed."""

    def __init__(self, file):
        self.file, self._unpack = file, zstandard.ZstdDecompressor()
        start = file.read(len(MAGIC) + 4)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet file")
        size = struct.unpack("<I", start[len(MAGIC) :])[0]
        head = json.loads(file.read(size))
        self.n, self.planes, self.block_bits = head["n"], head["planes"], head["block_bits"]
        arrays = [np.frombuffer(self._unpack.decompress(file.read(s)), "<i8") for s in head["sections"]]
        self.doc_ids, self.starts, self.places, self.ones, self.zeros = arrays
        self.base = len(start) + size + sum(head["sections"])
        self.blocks = max(1, -(-self.n // self.block_bits))
        self._last: dict[int, tuple[int, np.ndarray]] = {}

    def _bits(self, plane: int, block: int) -> np.ndarray:
        held = self._last.get(plane)
        if held is None or held[0] != block:
            k = plane * self.blocks + block
            self.file.seek(self.base + int(self.places[k]))
            raw = self._unpack.decompress(self.file.read(int(self.places[k + 1] - self.places[k])))
            size = min(self.block_bits, self.n - block * self.block_bits)
            held = self._last[plane] = (block, np.unpackbits(np.frombuffer(raw, np.uint8))[:size])
        return held[1]

    def _ones_before(self, plane: int, i: int) -> int:
        block, rest = divmod(i, self.block_bits)
        if block == self.blocks:
            block, rest = block - 1, self.block_bits
        bits = self._bits(plane, block)
        return int(self.ones[plane * self.blocks + block]) + int(np.count_nonzero(bits[:rest]))

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            block, rest = divmod(i, self.block_bits)
            bit = int(self._bits(p, block)[rest])
            ones = self._ones_before(p, i)
            value = value << 1 | bit
            i = int(self.zeros[p]) + ones if bit else i - ones
        return value

    def _span(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of token among the first i places lie after the last plane."""
        a, b = 0, i
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            x, y = self._ones_before(p, a), self._ones_before(p, b)
            if token >> (self.planes - 1 - p) & 1:
                a, b = int(self.zeros[p]) + x, int(self.zeros[p]) + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before place i."""
        a, b = self._span(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The place of occurrence j (from 0) of token."""
        a, b = self._span(token, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for p in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - p) & 1
            i = self._select_bit(p, one, i - int(self.zeros[p]) if one else i)
        return i

    def _select_bit(self, plane: int, one: int, j: int) -> int:
        """The place of the j-th one or zero of a plane."""
        own = self.ones[plane * self.blocks : (plane + 1) * self.blocks]
        before = own if one else np.arange(self.blocks) * self.block_bits - own
        block = int(np.searchsorted(before, j, side="right")) - 1
        where = np.flatnonzero(self._bits(plane, block) == one)
        return block * self.block_bits + int(where[j - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids: the planes' partitions undone from the last to the first."""
        values = np.zeros(self.n, np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bit = np.concatenate([self._bits(p, b) for b in range(self.blocks)]).astype(bool) if self.n else np.zeros(0, bool)
            z = int(self.zeros[p])
            up = np.empty_like(values)
            up[~bit] = values[:z]
            up[bit] = values[z:] | np.uint32(1 << (self.planes - 1 - p))
            values = up
        return values


def write(docs: DataFrame, path: str, end_id: int = 2, tokenizer_path: str | None = None, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, str, int, int]]:
    """Writes docs (doc_id, text) below path; (first id's number, file, documents, ids) of each shard in order of doc_id."""
    vocabulary = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoder, task = WordEncoder.at(vocabulary), TaskContext.get()
        ids, doc_ids, sizes = [], [], []
        for batch in slices(batches, "text", 8 << 20):
            got, at = encoder.encode(texts_of(batch.column("text")), end_id)
            ids.append(got)
            sizes.append(np.diff(at))
            doc_ids.append(np.asarray(batch.column("doc_id").fill_null(NULL_ID)))
        if not ids:
            return
        ids, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        data = build(ids, np.concatenate(doc_ids), starts)
        store, root = fs.FileSystem.from_uri(path)
        name = f"shard-{task.partitionId():06d}.wm"
        store.create_dir(root, recursive=True)
        own = f"{root}/.{name}.{task.taskAttemptId()}"
        with store.open_output_stream(own, compression=None) as out:
            out.write(data)
        store.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([name]), pa.array([len(starts) - 1]), pa.array([len(ids)])], ["shard", "file", "docs", "ids"])

    n = partitions_for(docs, "text", shard_bytes)
    dealt = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    shards, first, out = sorted(map(tuple, dealt.mapInArrow(run, "shard long, file string, docs long, ids long").collect())), 0, []
    for _, name, docs_in, ids_in in shards:
        out.append((first, name, docs_in, ids_in))
        first += ids_in
    return out


def read(spark: SparkSession, path: str, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ids: little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for first, name in zip(batch.column("first").to_pylist(), batch.column("file").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    shard = WaveletFile(f)
                    raw = shard.decode().astype("<u4").tobytes()
                at = shard.starts
                for a in range(0, len(shard.doc_ids), 2000):
                    b = min(a + 2000, len(shard.doc_ids))
                    own = shard.doc_ids[a:b]
                    parts = pa.array([raw[4 * i : 4 * j] for i, j in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(at[a:b] + first), pa.array(np.diff(at[a : b + 1])), parts], ["doc_id", "start", "n_tokens", "ids"])

    files = spark.createDataFrame([(s[0], s[1]) for s in shards], "first long, file string")
    return files.repartitionByRange(max(1, len(shards)), "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def occurrences(spark: SparkSession, path: str, shards: list[tuple[int, str, int, int]], token: int) -> DataFrame:
    """(file, n) of one id's occurrences, from a block a plane of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            names = batch.column("file").to_pylist()
            counts = []
            for name in names:
                with store.open_input_file(f"{root}/{name}") as f:
                    counts.append(WaveletFile(f).count(token))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], ["file", "n"])

    return spark.createDataFrame([(s[1],) for s in shards], "file string").repartition(max(1, len(shards))).mapInArrow(run, "file string, n long")


def stored(docs: DataFrame, **options) -> DataFrame:
    """Writes docs to a new path of the shared folder and reads them back."""
    path = shared_dir(docs.sparkSession, "wavelet")
    return read(docs.sparkSession, path, write(docs, path, **options))
