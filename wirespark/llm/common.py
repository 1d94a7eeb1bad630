"""What the operators share: the shared folder, written intermediate tables, word splitting, chunking."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a counted lookup table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a filter of hashes, and 64-bit words of each: 8 MB of bits at most.
FILTER_ROWS, FILTER_WORDS = 1 << 16, 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; where that is unset, a local one, if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage, outlives lost executors, is computed once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from written() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the context cleaner drop the shuffle files of finished jobs."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def filtered(df: DataFrame, hashes: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose 64-bit hash may be in that column of hashes, and the others, whose hash is not: each hash sets a bit of a table of bounded size, which is broadcast."""
    place, word, bit = f"shiftrightunsigned({column}, 10) & {FILTER_ROWS - 1}L", f"CAST(shiftrightunsigned({column}, 6) & {FILTER_WORDS - 1}L AS INT)", f"shiftleft(1L, CAST({column} & 63L AS INT))"
    words = [F.expr(f"coalesce(bit_or(CASE WHEN {word} = {k} THEN {bit} END), 0L)") for k in range(FILTER_WORDS)]
    bits = written(hashes.groupBy(F.expr(place).alias("_place")).agg(F.array(*words).alias("_bits")), "filter")
    marked = df.withColumn("_place", F.expr(place)).join(F.broadcast(bits), "_place", "left").withColumn("_maybe", F.expr(f"coalesce(_bits[{word}] & {bit}, 0L) <> 0L"))
    return marked.where("_maybe").select(*df.columns), marked.where("NOT _maybe").select(*df.columns)


def input_bytes(df: DataFrame, column: str) -> int:
    """The planner's size of df (that of its files), for choosing numbers of partitions; where it has none, the summed length of a column."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def partitions_for(df: DataFrame, column: str, bytes_each: int) -> int:
    """Partitions that hold about bytes_each, at least the session's shuffle parallelism."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df, column) // bytes_each))


def row_hash(*cols: str | Column) -> Column:
    """64 bits from columns, null and empty told apart."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*[x for c in cs for x in (c, c.isNull())])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text column of each holds about `most` bytes, one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def texts_of(column: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets, null as empty, in an array of their own: some string kernels misread slices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, raw = _raw(pc.fill_null(column.cast(pa.large_string()), ""))
    return _strings(offsets, raw)


def lowered(texts: pa.Array) -> pa.Array:
    """texts with A-Z in lower case, and nothing else."""
    offsets, raw = _raw(texts)
    return _strings(offsets, raw.lower())


def _raw(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), b""
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at - at[0], bytes(memoryview(data)[at[0] : at[-1]]) if data is not None else b""


def _strings(offsets: np.ndarray, raw: bytes) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and where each text's words start (one longer)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return flat, offsets


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each word in the array of distinct words."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return np.asarray(d.indices).astype(np.int64), d.dictionary


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each text's span."""
    cum = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return cum[offsets[1:]] - cum[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words (pandas' keyed siphash)."""
    import pandas as pd

    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False)
