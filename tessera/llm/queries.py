"""Queries opN_<name>, each over the whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import audit, bpe, decontaminate, host_reputation, jaccard, licenses, neighbours, passages, periodic, quality, token_files, wrappers
from tessera.llm import pipeline as stages
from tessera.sources import files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, on all cores even if it is one file."""
    return files.spread(_table(spark, sf_dir, name))


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_texts(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.suffix_dedup(_texts(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_texts(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.substring_dedup(_texts(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written(_texts(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_texts(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_texts(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_texts(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_learned_partitions, op2_html_wrappers, op3_suffix_dedup, op4_jaccard_join, op5_quality_classifier, op6_substring_dedup, op7_token_files, op8_decontamination, op9_host_reputation, op10_byte_bpe, op11_license_scan, op12_periodic_runs, op13_filter_audit, pipeline)}

ORACLE_SQL = {"op3_suffix_dedup": passages.oracle(), "op6_substring_dedup": passages.oracle(), "op8_decontamination": decontaminate.oracle(), "op9_host_reputation": host_reputation.oracle(), "op11_license_scan": licenses.oracle(), "op13_filter_audit": audit.oracle()}
