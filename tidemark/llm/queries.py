"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import collocations, decontamination, exact_dedup, jaccard_join, language_id, licenses, media_columns, merkle, mixing, quality, secret_scan, suffix_dedup, toxicity
from tidemark.llm._common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_digest(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_ids(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_digest(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_digest(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_digest(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_REGISTERED = (
    op1_media_columns, op2_secret_scans, op3_source_mixing, op4_benchmark_decontamination, op5_language_id,
    op6_ngram_jaccard_join, op7_license_scans, op8_toxicity, op9_suffix_array_dedup, op10_quality_classifier,
    op11_merkle_manifest, op12_exact_dedup, op13_phrase_collocations,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _REGISTERED}

#: Only what SQL can express; the others are tested against brute force, exact round trips or held-out labels.
ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": decontamination.ORACLE, "op6_ngram_jaccard_join": jaccard_join.ORACLE, "op7_license_scans": licenses.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_phrase_collocations": collocations.ORACLE,
}
