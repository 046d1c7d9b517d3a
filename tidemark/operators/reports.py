"""Aggregates that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import SEVERITIES, severity_rank


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, findings, files for every severity, unused ones with zeros."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counted = findings.groupBy("severity").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))
    return F.broadcast(every).join(counted, "severity", "left").select("severity", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("files", F.lit(0)).alias("files"))


def rule_descriptors(findings: DataFrame) -> DataFrame:
    """rule_id, rule_index, severity (highest), message, advice (first that isn't blank), cwe and kinds (distinct, in order of appearance), sorted by id."""
    order = F.struct("file", "range.start.line", "range.start.column", "source_id")
    # One row for each form that a rule's findings take, so that what follows is small whatever a rule's share of all findings.
    forms = findings.groupBy("rule_id", "severity", "message", "advice", "cwe", "kinds").agg(F.min(order).alias("o"))
    first = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col("o")))
    grouped = forms.groupBy("rule_id").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), first("message").alias("message"), first("advice").alias("advice"))
    for c in ("cwe", "kinds"):
        values = forms.select("rule_id", "o", F.col(c).alias("every"), F.posexplode(c).alias("p", "v")).groupBy("rule_id", "v").agg(F.min(F.struct("o", "every", "p")).alias("at"))
        listed = values.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias(c))
        grouped = grouped.join(listed, "rule_id", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return grouped.withColumn("rule_index", F.row_number().over(Window.orderBy("rule_id")) - 1)


def finding_json(columns: list[str]) -> Column:
    """One JSON object, keys in the order given, keys of null values left out."""
    return F.to_json(F.struct(*columns))


def merged_by_id(specs: DataFrame, key: str = "id", position: str = "pos") -> DataFrame:
    """Duplicate ids: the last definition in the first one's place."""
    rest = [c for c in specs.columns if c not in (key, position)]
    return specs.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("s"), F.min(position).alias(position), F.count("*").alias("definitions")).select(key, position, *[f"s.{c}" for c in rest], "definitions")
