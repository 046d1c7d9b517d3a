"""A corpus pipeline of five training-data operators; each stage works on all that the stage before it kept.

Rows at the edges, at every stage: a null or empty text is not toxic, is near no other, holds no benchmark item and no secret, and gives the mix no word, so its row stays. Very long texts are treated whole. Rows
that repeat an id are rows of their own; those that repeat a text, too, are near duplicates, of which one stays, as of ties for the smallest doc_id. A null doc_id is an id like others but never that of a label. Other columns are carried
along as they are, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, jaccard_join, mixing, secret_scan, toxicity
from tidemark.llm._common import checkpointed, table


#: Rows that Spark hands to Python at once. Texts are handled in slices anyway; a stage's rows stand beside each other in the executor and in its Python workers, which live on into the next stages.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's rows, checkpointed while Python gets few rows at once; the session's setting is as before afterwards."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(BATCH_ROWS))
    try:
        return checkpointed(make())
    finally:
        spark.conf.set(_ROWS, before)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go."""
    return in_small_batches(spark, lambda: toxicity.reject_toxic(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return in_small_batches(spark, lambda: jaccard_join.one_of_each(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return in_small_batches(spark, lambda: decontamination.clean(docs, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay."""
    return in_small_batches(spark, lambda: secret_scan.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix_digest(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
]

#: Stages learn models and draw at random, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)
