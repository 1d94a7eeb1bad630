"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespark.llm import fingerprints, lattice, line_dedup, minhash, mixing, packing, quality, repeats, warc, wavelet
from wirespark.llm.common import documents


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"), "source", counts=True).drop("source")


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.stored(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(documents(spark, sf_dir))


def op5_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir).select("doc_id", "text"), measures=quality.BASE, verdict="passed")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *quality.BASE, base.alias("base_failed"), (~base & F.col("passed")).alias("kept"))


def op7_edit_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(documents(spark, sf_dir))


def op8_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir), n=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {f.__name__: f for f in (op1_pareto_mix, op2_site_lines, op3_wavelet_tokens, op4_lattice_score, op5_run_length_repeats, op6_rule_cascade, op7_edit_walks, op8_min_slack_packing, op9_warc_derivatives, op10_bottom_k)}
ORACLE_SQL: dict[str, str] = {"op2_site_lines": line_dedup.SQL, "op9_warc_derivatives": warc.SQL}
