"""Suffix-array dedup with a run-length index: bytes covered by a long string of an earlier document are removed.

1. Routing. Every window of LENGTH bytes has a key, the least hash of the GRAM-byte strings in it: equal windows have equal keys.
   Keys that occur in one document only are ruled out (each chunk sends its distinct keys with its least and greatest
   document, so a hot key costs a row a chunk).
2. Windows in a row with one key make a strip, known by a digest; each chunk tells its digests with their least documents.
   If all strips of a key are equal, that is the answer. Else the part with the least document of all owns a digest
   and alone sends its bytes to the shard of its key. Strips of a hot key are split first, see Windows.split().
3. Index. A shard sorts the suffixes of its distinct strings, keeps their Burrows-Wheeler transform as runs, and samples
   suffixes at run ends. Match lengths are computed at the samples alone and streamed along the text (a suffix that is
   no run's first matches one byte less than the suffix one to the left), and all windows of an interval
   whose matches are LENGTH or longer are one string: its first document is the least of theirs. A shard is indexed in
   batches of whole keys of a bounded size.
4. Each chunk gets back, for its strips, the first document of each window, and removes what earlier documents cover.

Only hashes and strips travel, in rows of many entries; a row goes to at most FAN buckets of shards or parts and is dealt
again where there are more, so that rows grow as the input does. Texts are written once to the shared folder, and what
comes back to a part of them is a file of that part, which its task reads. Tasks depend on written tables alone, so lost
ones can be run again anywhere.

Null texts count as empty; a null id counts as the smallest; rows equal in id are one document: they don't remove each
other's bytes. Texts under LENGTH bytes stay whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespark.llm.common import discard, free_shuffles, mix64, partitions_for, shared_dir, slices, texts_of, written

LENGTH, GRAM = 50, 16
CHUNK_BYTES, BUCKET_BYTES, BATCH_BYTES = 2 << 20, 2 << 20, 2 << 20
#: Buckets that one row's entries are dealt to at most; strips of a key from which on they are split.
FAN, HOT = 512, 2000
REGROUP_BYTES = 4 << 20
NULL_ID = -(1 << 63)
SIDE = (LENGTH - GRAM) // 2
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
STEP, BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; the first bytes of all numbers come first, then the second ones, so that those that vary little stand together."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    body = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(body), 3)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    at, out = 4 + int.from_bytes(raw[:4], "little"), []
    for kind, n in (x.split(",") for x in raw[4:at].decode().split(";")):
        size = np.dtype(kind).itemsize
        held = np.frombuffer(raw, np.uint8, size * int(n), at).reshape(size, int(n))
        out.append(np.ascontiguousarray(held.T).view(kind).reshape(-1))
        at += size * int(n)
    return out


class Windows:
    """The windows of a chunk of texts: keys, strips and strips' digests."""

    def __init__(self, texts: pa.Array, doc_ids: np.ndarray):
        _, offsets, data = texts.buffers()
        self.starts = np.frombuffer(offsets, np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        n = int(self.starts[-1])
        self.raw = np.frombuffer(data, np.uint8)[:n] if n else np.zeros(0, np.uint8)
        self.doc_ids = doc_ids
        if n < LENGTH:
            self._set(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
            return
        h, size = self.raw.astype(np.uint64), 1
        h += np.uint64(1)
        while size < GRAM:  # h: hashes of `size` bytes
            h[:-size] = mix_step(h[:-size], h[size:])
            size *= 2
        self.grams = h = mix64(h)
        self.digests = np.cumsum(h * powers(n))
        least, size, width = h, 1, LENGTH - GRAM + 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        # windows that end behind their text are none
        least = least[: n - LENGTH + 1].copy()
        for k in range(1, LENGTH):
            at = self.starts[1:] - k
            least[at[(at >= self.starts[:-1]) & (at < len(least))]] = NONE
        change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]), [True]]))
        first, last = change[:-1], change[1:] - 1
        ok = least[first] != NONE  # every text ends in windows that are none, so no strip crosses texts
        self._set(first[ok], last[ok], least[first[ok]])

    def _set(self, first: np.ndarray, last: np.ndarray, key: np.ndarray) -> None:
        self.first, self.last, self.key = first, last, key
        self.doc = np.searchsorted(self.starts, first, side="right") - 1
        self.digest = mix64(self._content(first, last + LENGTH - GRAM) + key + (last - first).astype(np.uint64) * STEP) if len(first) else np.zeros(0, np.uint64)

    def _content(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the GRAM-byte strings that start from a to b, moved to place 0."""
        before = np.where(a > 0, self.digests[a - 1], np.uint64(0))
        return (self.digests[b] - before) * inverse_powers(len(self.raw))[a]

    def split(self, hot: np.ndarray) -> None:
        """Strips of hot keys (sorted) are cut: windows with SIDE bytes or more before the first string of the key in them are keyed by these bytes too, the others by as many behind it. Equal windows still have equal keys."""
        is_hot = _in(self.key, hot)
        if not is_hot.any():
            return
        n = (self.last - self.first + 1)[is_hot]
        start = np.repeat(self.first[is_hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, place = np.repeat(self.key[is_hot], n), start.copy()
        while (off := self.grams[place] != key).any():
            place[off] += 1
        before = place - start >= SIDE
        heads = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1]) | (before[1:] != before[:-1])]))
        last = start[np.append(heads[1:], len(start)) - 1]
        start, key, place, before = start[heads], key[heads], place[heads], before[heads]
        own = mix64(self._content(place - SIDE * before, place + SIDE * ~before) + np.where(before, key, ~key))
        rest = self.first[~is_hot], self.last[~is_hot], self.key[~is_hot]
        self._set(*(np.concatenate(x) for x in zip(rest, (start, last, own), strict=True)))

    def take(self, keep: np.ndarray) -> None:
        self.first, self.last, self.key, self.doc, self.digest = (x[keep] for x in (self.first, self.last, self.key, self.doc, self.digest))


def mix_step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * STEP) ^ (b + (a >> np.uint64(29)))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _upto(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


def powers(n: int) -> np.ndarray:
    return _upto("up", STEP, n)


def inverse_powers(n: int) -> np.ndarray:
    return _upto("down", BACK, n)


def eights(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number, zeros behind the string's end."""
    n, out = len(text), np.zeros(len(text), np.uint64)
    for k in range(8):
        part = np.zeros(n, np.uint64)
        part[: n - k] = text[k:]
        part[left <= k] = 0
        out |= part << np.uint64(8 * (7 - k))
    return out


def suffix_order(wide: np.ndarray, string_of: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of a text by their suffixes, each up to its string's end; ends are less than bytes, and less for earlier strings. wide: eights() of the text; left: bytes to the string's end."""
    n, size = len(wide), 7
    key = wide >> np.uint64(8) << np.uint64(8) | np.minimum(left, size).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = _heads(np.concatenate([[False], key[1:] != key[:-1]]))
    del key
    tied = np.arange(n)
    while True:
        own = rank[order[tied]]  # tied places of the order hold whole groups
        same = own[1:] == own[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        tied, own = tied[keep], own[keep]
        if not len(tied):
            return order
        places = order[tied]
        # suffixes that end within their first bytes are told apart by their strings alone
        follow = np.where(left[places] <= size, string_of[places], n + rank[np.minimum(places + size, n - 1)])
        again = np.argsort(own.astype(np.uint64) << np.uint64(32) | follow.astype(np.uint64))
        places, follow = places[again], follow[again]
        order[tied] = places
        at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])]))
        rank[places] = tied[np.repeat(at, np.diff(np.append(at, len(tied))))]
        size *= 2


def _heads(new: np.ndarray) -> np.ndarray:
    """For each place of an order, where its group starts."""
    at = np.where(new, np.arange(len(new)), 0)
    return np.maximum.accumulate(at)


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of distinct strings, with suffixes sampled at run ends."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.string_of = np.repeat(np.arange(len(strings)), sizes)
        self.left = self.starts[1:][self.string_of] - np.arange(len(self.text))
        self.wide = eights(self.text, self.left)
        self.order = suffix_order(self.wide, self.string_of, self.left)
        # what stands before a string's first byte is that string's own end: each a run of its own
        before = np.where(self.order == self.starts[self.string_of[self.order]], -1 - self.string_of[self.order], self.text[self.order - 1].astype(np.int64))
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(before) else np.zeros(0, np.int64)
        self.run_bytes, self.run_heads = before[heads], heads
        self.run_ends = np.append(heads[1:], len(before)) - 1 if len(before) else heads
        self.first_suffixes, self.last_suffixes = self.order[heads], self.order[self.run_ends]

    def matches(self) -> np.ndarray:
        """For each place of the text, the bytes its suffix has in common with the suffix before it in order: computed for the first suffixes of runs, against the last ones of the runs before, then streamed."""
        n = len(self.text)
        if not n:
            return np.zeros(0, np.int64)
        lengths = np.zeros(len(self.first_suffixes), np.int64)
        lengths[1:] = self._common(self.first_suffixes[1:], self.last_suffixes[:-1])
        at = np.full(n, -1, np.int64)
        at[self.first_suffixes] = self.first_suffixes
        known = np.zeros(n, np.int64)
        known[self.first_suffixes] = lengths
        source = np.maximum.accumulate(at)  # every string's first place is a run of its own, so none reaches into another
        return np.maximum(known[source] - (np.arange(n) - source), 0)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes, up to the strings' ends."""
        most, out, live = np.minimum(self.left[a], self.left[b]), np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            done = out[live]
            differ = self.wide[a[live] + done] ^ self.wide[b[live] + done]
            same = np.zeros(len(live), np.int64)
            for k in range(1, 9):
                same += differ < np.uint64(1 << (64 - 8 * k)) if k < 8 else differ == 0
            out[live] = np.minimum(done + same, most[live])
            live = live[(same == 8) & (done + 8 < most[live])]
        return out

    def first_documents(self, docs: np.ndarray) -> np.ndarray:
        """For each place, the least document among the strings that hold the LENGTH bytes there; docs: each string's least document. Places nearer to a string's end have no meaning."""
        match = self.matches()[self.order]
        if not len(match):
            return np.zeros(0, np.int64)
        heads = np.flatnonzero(np.concatenate([[True], match[1:] < LENGTH]))
        of = docs[self.string_of[self.order]]
        least = np.minimum.reduceat(of, heads)
        out = np.empty(len(match), np.int64)
        out[self.order] = np.repeat(least, np.diff(np.append(heads, len(match))))
        return out


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, Windows, pa.RecordBatch]]:
    """Slices of one part each with their windows."""
    for batch in slices(batches, "text", most):
        parts = np.asarray(batch.column("part"))
        cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            one = batch.slice(a, b - a)
            yield int(parts[a]), Windows(texts_of(one.column("text")), np.asarray(one.column("doc_id").fill_null(NULL_ID))), one


class Entries:
    """Columns of equal length, of which the first says where an entry goes (modulo the number of buckets), and if `ragged` bytes for each entry, the last column's number."""

    def __init__(self, *columns: np.ndarray, text: np.ndarray | None = None, at: np.ndarray | None = None):
        self.columns, self.text = list(columns), text
        self.at = at if at is not None or text is None else np.cumsum(columns[-1].astype(np.int64)) - columns[-1]

    def of(self, rows: np.ndarray) -> bytes:
        own = [c[rows] for c in self.columns]
        if self.text is None:
            return packed(*own)
        raw = self.text
        text = b"".join(raw[a : a + n] for a, n in zip(self.at[rows].tolist(), own[-1].tolist(), strict=True))
        return packed(*own, np.frombuffer(text, np.uint8))

    @classmethod
    def joined(cls, blobs: list[bytes], ragged: bool) -> Entries:
        columns = [np.concatenate(x) for x in zip(*map(unpacked, blobs), strict=True)]
        return cls(*columns[:-1], text=columns[-1].tobytes()) if ragged else cls(*columns)

    def rows(self, buckets: int, span: int, salt: int, kind: int) -> Iterator[pa.RecordBatch]:
        """A row for each `span` of buckets that entries go to."""
        if not len(self.columns[0]):
            return
        to = self.columns[0] % self.columns[0].dtype.type(buckets) // self.columns[0].dtype.type(span)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1], [True]]))
        blobs = [self.of(order[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        n = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array(to[order[cuts[:-1]]].astype(np.int64)), pa.array(np.full(n, salt)), pa.array(np.full(n, kind)), pa.array(blobs, pa.binary())], ["bucket", "salt", "kind", "blob"])


ROWS = "bucket long, salt long, kind long, blob binary"


def _spans(buckets: int, fan: int) -> list[int]:
    """Buckets that go together in each hop, `fan` such groups of each at most; the last is 1."""
    spans = [1]
    while -(-buckets // spans[0]) > fan:
        spans.insert(0, spans[0] * fan)
    return spans


def _routed(sent: DataFrame, buckets: int, plan: Plan, ragged: bool = False, there: DataFrame | None = None) -> DataFrame:
    """Rows of Entries.rows(.., _spans(..)[0], ..), and those that are `there` already, at their last buckets; (bucket, kind) in order."""

    def deal(span: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, key = [], 0, None
            for batch in batches:
                for b, salt, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and ((b, kind) != key or size > REGROUP_BYTES):
                        yield from Entries.joined(held, ragged).rows(buckets, span, salt, key[1])
                        held, size = [], 0
                    key = (b, kind)
                    held.append(blob)
                    size += len(blob)
            if held:
                yield from Entries.joined(held, ragged).rows(buckets, span, salt, key[1])

        return run

    spans, tasks = _spans(buckets, plan.fan), plan.buckets
    for span in spans[1:]:
        sent = sent.repartition(tasks, "bucket", "salt").sortWithinPartitions("bucket", "kind").mapInArrow(deal(span), ROWS)
    sent = sent if there is None else sent.unionByName(there)
    return sent.repartition(min(buckets, tasks), "bucket").sortWithinPartitions("bucket", "kind")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """(bucket, blobs by kind) of one bucket after the other; rows are sorted by bucket."""
    bucket, blobs = None, {}
    for batch in batches:
        for b, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True):
            if b != bucket and blobs:
                yield bucket, blobs
                blobs = {}
            bucket = b
            blobs.setdefault(kind, []).append(blob)
    if blobs:
        yield bucket, blobs


def _to_parts(rows: DataFrame, plan: Plan, name: str) -> str:
    """Writes rows of entries that go to parts, a folder a part; the path."""
    path = shared_dir(rows.sparkSession, name)
    _routed(rows, plan.n_parts, plan).select(F.col("bucket").alias("part"), "blob").write.partitionBy("part").parquet(path)
    return path


def _of_part(path: str, part: int, kinds: tuple) -> list[np.ndarray]:
    """The columns, after the first, of entries that were sent to a part."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/part={part}").type == fs.FileType.NotFound:
        return [np.zeros(0, k) for k in kinds]
    files = store.get_file_info(fs.FileSelector(f"{root}/part={part}"))
    blobs = (b for f in files if f.path.endswith(".parquet") for b in pq.ParquetFile(store.open_input_file(f.path)).read(["blob"]).column(0).to_pylist())
    return Entries.joined(list(blobs), False).columns[1:]


class Plan:
    """Numbers of shards and parts, and what bounds chunks and rows."""

    def __init__(self, parts: DataFrame, buckets: int, chunk_bytes: int, fan: int, hot: int, batch_bytes: int):
        self.buckets, self.chunk_bytes, self.fan, self.hot, self.batch_bytes = buckets, chunk_bytes, fan, hot, batch_bytes
        self.n_parts = (parts.agg(F.max("part")).first()[0] or 0) + 1
        self.to_bucket, self.to_part = _spans(buckets, fan)[0], _spans(self.n_parts, fan)[0]

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Windows, pa.RecordBatch]]:
        return _chunks(batches, self.chunk_bytes)

    def for_buckets(self, entries: Entries, part: int, kind: int = 0) -> Iterator[pa.RecordBatch]:
        return entries.rows(self.buckets, self.to_bucket, part, kind)

    def for_parts(self, entries: Entries, bucket: int, kind: int = 0) -> Iterator[pa.RecordBatch]:
        return entries.rows(self.n_parts, self.to_part, bucket, kind)


def _keys(docs: DataFrame, plan: Plan) -> DataFrame:
    """To parts: their keys that occur in two documents or more, and whether they are hot."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, _ in plan.chunks(batches):
            key, least, most, times = _groups(w.key, w.doc_ids[w.doc])
            two = least != most
            keys, docs, times = np.concatenate([key, key[two]]), np.concatenate([least, most[two]]), np.concatenate([times, 0 * times[two]])
            yield from plan.for_buckets(Entries(keys, docs, np.full(len(keys), part, np.int32), times.astype(np.int32)), part)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            key, doc, part, times = Entries.joined(blobs[0], False).columns
            order = np.argsort(key)
            key, doc, part = key[order], doc[order], part[order]
            firsts = np.flatnonzero(_firsts(key))
            several = np.minimum.reduceat(doc, firsts) != np.maximum.reduceat(doc, firsts)
            hot = np.add.reduceat(times[order].astype(np.int64), firsts) > plan.hot
            size = np.diff(np.append(firsts, len(key)))
            keep = np.repeat(several, size)
            yield from plan.for_parts(Entries(part[keep], key[keep], np.repeat(hot, size)[keep].astype(np.uint8)), bucket)

    return _routed(docs.mapInArrow(tell, ROWS), plan.buckets, plan).mapInArrow(meet, ROWS)


class _Wanted:
    """The keys that came back to a part."""

    def __init__(self, path: str, part: int):
        key, hot = _of_part(path, part, (np.uint64, np.uint8))
        self.keys, self.hot = np.unique(key), np.unique(key[hot > 0])

    def narrow(self, w: Windows) -> None:
        """Leaves only strips of these keys, and splits those of hot ones."""
        w.take(_in(w.key, self.keys))
        w.split(self.hot)


def _each_part(found: Iterator[tuple[int, Windows, pa.RecordBatch]], *tables) -> Iterator[tuple]:
    """found with what tables (of a part) make of its part, made once for parts in a row."""
    last, made = None, []
    for part, *rest in found:
        if part != last:
            last, made = part, [t(part) for t in tables]
        yield (part, *rest, *made)


def _owners(docs: DataFrame, keys_at: str, plan: Plan) -> DataFrame:
    """To parts (kind 0): first documents of digests, or that they own one, whose bytes are needed; to buckets (kind 1): digests, parts that have them, first documents."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, _, wanted in _each_part(plan.chunks(batches), lambda part: _Wanted(keys_at, part)):
            wanted.narrow(w)
            digest, doc, _, _ = _groups(w.digest, w.doc_ids[w.doc])
            key = _groups(w.digest, w.key)[1]  # a digest has one key
            yield from plan.for_buckets(Entries(key, digest, doc, np.full(len(key), part, np.int32)), part)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            key, digest, doc, part = Entries.joined(blobs[0], False).columns
            order = np.lexsort((part, doc, digest, key))
            key, digest, doc, part = (x[order] for x in (key, digest, doc, part))
            first = _firsts(digest)
            place = np.cumsum(first) - 1
            least = doc[first][place]
            # keys of one digest only need no index
            heads = np.flatnonzero(_firsts(key))
            alone = np.repeat(np.add.reduceat(first.astype(np.int64), heads) == 1, np.diff(np.append(heads, len(key))))
            owned = ~alone & first
            told = alone | owned
            yield from plan.for_parts(Entries(part[told], digest[told], least[told], owned[told].astype(np.uint8)), bucket)
            held = ~alone
            if held.any():
                # goes to its bucket once more, with the strips
                yield from Entries(key[held], digest[held], part[held], least[held]).rows(plan.buckets, 1, bucket, 1)

    return _routed(docs.mapInArrow(tell, ROWS), plan.buckets, plan).mapInArrow(meet, ROWS)


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, the least value of each, the greatest, their number)."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    at = np.flatnonzero(_firsts(keys))
    if not len(at):
        return keys, values, values, at
    return keys[at], np.minimum.reduceat(values, at), np.maximum.reduceat(values, at), np.diff(np.append(at, len(keys)))


def _in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)


def _strips(docs: DataFrame, held: DataFrame, keys_at: str, owners_at: str, plan: Plan) -> DataFrame:
    """To parts: for their strips, by digest, from which place on which document is the first."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def owned(part: int) -> np.ndarray:
            digest, _, own = _of_part(owners_at, part, (np.uint64, np.int64, np.uint8))
            return np.unique(digest[own > 0])

        for part, w, _, wanted, mine in _each_part(plan.chunks(batches), lambda part: _Wanted(keys_at, part), owned):
            wanted.narrow(w)
            w.take(_in(w.digest, mine))
            _, one = np.unique(w.digest, return_index=True)
            yield from plan.for_buckets(Entries(w.key[one], w.digest[one], (w.last[one] + LENGTH - w.first[one]).astype(np.int32), text=w.raw.tobytes(), at=w.first[one]), part)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            strips = Entries.joined(blobs[0], True)
            key, digest, size = strips.columns
            _, held, part, least = Entries.joined(blobs[1], False).columns
            order = np.argsort(held, kind="stable")
            held, part, least = held[order], part[order], least[order]
            docs = least[np.searchsorted(held, digest)]
            # by key and document; two chunks of a part may send one strip
            order = np.lexsort((digest, docs, key))
            order = order[_firsts(digest[order])]
            heads = np.flatnonzero(_firsts(key[order]))
            total = np.cumsum(size[order].astype(np.int64))
            begin = 0
            while begin < len(order):
                done = total[begin - 1] if begin else 0
                stops = np.append(heads[heads > begin], len(order))
                end = int(stops[max(0, int(np.searchsorted(total[stops - 1], done + plan.batch_bytes, side="right")) - 1)])
                at = order[begin:end]
                yield from plan.for_parts(_answers(strips, at, digest[at], docs[at], held, part), bucket)
                begin = end

    both = docs.mapInArrow(tell, ROWS)
    # held rows are at their buckets already: they join the strips' last hop
    return _routed(both, plan.buckets, plan, True, held).mapInArrow(meet, ROWS)


def _answers(strips: Entries, at: np.ndarray, digest: np.ndarray, docs: np.ndarray, held: np.ndarray, part: np.ndarray) -> Entries:
    """(part, digest, offset, document) for strips by document: pieces of each strip for all parts that have it (held: their digests in order, part)."""
    sizes = strips.columns[-1]
    index = RunLengthIndex([strips.text[a : a + n] for a, n in zip(strips.at[at].tolist(), sizes[at].tolist(), strict=True)])
    found = index.first_documents(docs)
    real = index.left >= LENGTH
    places, found, owner = np.flatnonzero(real), found[real], index.string_of[real]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
    places, found, owner = places[new], found[new], owner[new]
    offset = (places - index.starts[owner]).astype(np.int32)
    del index
    # each piece once for each part that has its strip
    lo, hi = np.searchsorted(held, digest, "left"), np.searchsorted(held, digest, "right")
    n = (hi - lo)[owner]
    piece = np.repeat(np.arange(len(owner)), n)
    to = part[np.repeat(lo[owner] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return Entries(to, digest[owner[piece]], offset[piece], found[piece])


class _Answers:
    """What came back for a part: by digest, offsets and first documents."""

    def __init__(self, owners_at: str, strips_at: str, part: int):
        known, least, own = _of_part(owners_at, part, (np.uint64, np.int64, np.uint8))
        digest, offset, doc = _of_part(strips_at, part, (np.uint64, np.int32, np.int64))
        known, least = known[own == 0], least[own == 0]
        digest, offset, doc = np.concatenate([digest, known]), np.concatenate([offset, np.zeros(len(known), np.int32)]), np.concatenate([doc, least])
        order = np.lexsort((offset, digest))
        digest, offset, doc = digest[order], offset[order], doc[order]
        new = np.concatenate([[True], (digest[1:] != digest[:-1]) | (offset[1:] != offset[:-1])]) if len(digest) else np.zeros(0, bool)  # chunks of a part may have one strip
        digest, self.offset, self.doc = digest[new], offset[new], doc[new]
        self.first = np.flatnonzero(_firsts(digest))
        self.digest, self.n = digest[self.first], np.diff(np.append(self.first, len(digest)))


def _covered(w: Windows, answers: _Answers) -> np.ndarray:
    """Which bytes of a chunk earlier documents cover."""
    marks = np.zeros(len(w.raw) + 1, np.int32)
    if len(w.key) and len(answers.digest):
        k = np.minimum(np.searchsorted(answers.digest, w.digest), len(answers.digest) - 1)
        hit = answers.digest[k] == w.digest
        k, first, last, doc = k[hit], w.first[hit], w.last[hit], w.doc_ids[w.doc[hit]]
        n = answers.n[k]
        at = np.repeat(answers.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner = np.repeat(np.arange(len(k)), n)
        start = first[owner] + answers.offset[at]
        final = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
        stop = np.where(final, last[owner], np.append(start[1:], 0) - 1)  # the last window of each piece
        early = answers.doc[at] < doc[owner]
        marks += np.bincount(start[early], minlength=len(marks)).astype(np.int32)
        marks -= np.bincount(stop[early] + LENGTH, minlength=len(marks)).astype(np.int32)
    return np.cumsum(marks)[:-1] > 0


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN, hot: int = HOT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of docs (doc_id, text): the removed spans [from, to) of each text's bytes, and the bytes left."""
    parts = written(docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")), "repeat-texts")
    plan = Plan(parts, partitions_for(docs, "text", bucket_bytes), chunk_bytes, fan, hot, batch_bytes)
    keys_at = _to_parts(_keys(parts, plan), plan, "repeat-keys")
    free_shuffles(docs.sparkSession)
    owners = written(_owners(parts, keys_at, plan), "repeat-owners")
    owners_at = _to_parts(owners.where("kind = 0"), plan, "repeat-owned")
    free_shuffles(docs.sparkSession)
    strips_at = _to_parts(_strips(parts, owners.where("kind = 1"), keys_at, owners_at, plan), plan, "repeat-strips")
    discard(owners)
    free_shuffles(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, batch, wanted, answers in _each_part(plan.chunks(batches), lambda part: _Wanted(keys_at, part), lambda part: _Answers(owners_at, strips_at, part)):
            wanted.narrow(w)
            gone = _covered(w, answers)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            raw, spans, kept = w.raw.tobytes(), [], []
            for a, b in zip(w.starts[:-1].tolist(), w.starts[1:].tolist(), strict=True):
                i, j = np.searchsorted(edge, [a, b], side="right")
                # a run may go on from the text before or into the next one
                cut = [a] * bool(a < b and gone[a]) + [x for x in edge[i:j].tolist() if x < b] + [b] * bool(a < b and gone[b - 1])
                own = list(zip(cut[::2], cut[1::2], strict=True))
                spans.append([{"start": x - a, "stop": y - a} for x, y in own])
                if own:
                    ends = [a, *(x for s in own for x in s), b]
                    kept.append(b"".join(raw[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True)))
                else:
                    kept.append(raw[a:b])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(w.starts)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return parts.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
