"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each stage on what its predecessor kept.

Each stage makes an empty table of an empty one, and carries the columns of documents, whatever their names, up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirespark.llm import line_dedup, minhash, mixing, packing, quality
from wirespark.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts have no words and are rejected; equal rows share their fate."""
    return quality.kept(docs)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their sources; n_chars follows the text. A null source is a source; a null text stays null; equal rows are pages each."""
    done = line_dedup.drop_boilerplate(docs, "source")
    return done.selectExpr(*[f"CAST(char_length(text) AS BIGINT) AS {c}" if c == "n_chars" else c for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8. It is that of the least id (null is the greatest), then of the least hash of id and text; of rows equal in both one stays. Texts without words all stay."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: in no row, in one or in two. A null source is a source of its own, ordered last; texts without words stay as they are; equal rows are taken together."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, in sequences. A null text counts as empty: its end id alone; rows with equal or null ids are packed each."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", site_lines), ("near-dedup", near_dedup), ("mixing sources", mix_sources), ("packing", pack)]
#: SQL has neither the tokenizer nor the components.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
