"""Streams of documents: files as they arrive, decoded without state, since nothing carries over from one document to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wirespark.sources import exi
from wirespark.sources.codec import Options

FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def read_rows(spark: SparkSession, path: str, root: str, schema: T.StructType, options: Options | None = None) -> DataFrame:
    """A stream of (path, fields...), one document a file, in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(path)
    return exi.decode_rows(files.select("path", "content"), root, schema, options, "permissive")


def read_events(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """A stream of (path, seq, event, ns, local, value) from schema-less documents."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(path)
    return exi.event_rows(exi.decode_events(files.select("path", "content"), options, "permissive"), "path")
