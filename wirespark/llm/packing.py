"""Packing documents into sequences by minimum bin slack.

Documents are tokenised whole, with an end id, and grouped as they are read (a group is a slice of an input partition,
bounded in bytes; nothing is shuffled). Whole capacities of a long document are sequences of their own; what remains of
each document is an item. Each sequence takes the longest item left and, by a subset-sum dynamic program on bitsets over
the remaining lengths and their counts, the multiset that comes closest to the capacity; the counts are traced back. If
no multiset fills the sequence, the shortest item left is cut to fill it. What is left at the end of a group, less than a
sequence, is cut into sequences whose lengths are powers of two, which need no padding. Together: no padding at all.

Null texts count as empty; an empty text is its end id alone. Rows with null or equal ids are packed one by one. An
empty table gives an empty result. Output columns are fixed; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wirespark.llm.common import slices, texts_of
from wirespark.llm.tokens import WordEncoder, default_path

GROUP_BYTES = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[length] of each, whose sum comes closest to room without exceeding it."""
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        wide = reach
        for _ in range(min(counts[length], room // length)):
            more = (wide | wide << length) & mask
            if more == wide:
                break
            wide = more
        reach = wide
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:  # the fewest of this length with which the rest was reachable before
            n, total = n + 1, total - length
        if n:
            taken[length] = n
    return taken


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each document's whole length in pieces."""
    out, items = [], {}
    for doc, n in enumerate(lengths):
        whole = n // capacity * capacity
        out.extend([(doc, at, capacity)] for at in range(0, whole, capacity))
        if n > whole:
            items.setdefault(n - whole, []).append((doc, whole))
    counts, left = {k: len(v) for k, v in items.items()}, sum(k * len(v) for k, v in items.items())

    def pop(length: int) -> tuple[int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return items[length].pop()

    while left >= capacity:
        first = max(counts)
        pieces = [(*pop(first), first)]
        room = capacity - first
        for length, n in fill(counts, room).items() if room else ():
            pieces.extend((*pop(length), length) for _ in range(n))
            room -= n * length
        if room:  # all that is left is longer than the room
            length = min(counts)
            doc, at = pop(length)
            pieces.append((doc, at, room))
            rest = length - room
            items.setdefault(rest, []).append((doc, at + room))
            counts[rest] = counts.get(rest, 0) + 1
        out.append(pieces)
        left -= capacity
    tail = [(doc, at, length) for length in sorted(counts, reverse=True) for doc, at in items[length]]
    while left:
        room = 1 << (left.bit_length() - 1)
        left, pieces = left - room, []
        while room:
            doc, at, length = tail.pop(0)
            n = min(length, room)
            pieces.append((doc, at, n))
            room -= n
            if n < length:
                tail.insert(0, (doc, at + n, length - n))
        out.append(pieces)
    return out


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer_path: str | None = None) -> DataFrame:
    """One row a piece of docs (doc_id, text): its ids (little-endian unsigned 32-bit) and where it lies."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = WordEncoder.at(path), TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", GROUP_BYTES):
            ids, at = encoder.encode(texts_of(batch.column("text")), end_id)
            raw = ids.astype("<u4").tobytes()
            sizes = np.diff(at).tolist()
            doc_ids, rows = batch.column("doc_id").to_pylist(), []
            for k, pieces in enumerate(pack_lengths(sizes, capacity)):
                offset = 0
                for doc, start, length in pieces:
                    a = 4 * (int(at[doc]) + start)
                    rows.append((doc_ids[doc], start, length, raw[a : a + 4 * length], sizes[doc], task + k, offset))
                    offset += length
            task += k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 3 + (pa.binary(),) + (pa.int64(),) * 3, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
