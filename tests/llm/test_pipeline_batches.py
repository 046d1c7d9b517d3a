"""Stages of the pipeline hand Python few rows at once, and leave the session's setting as it was."""

import pyarrow as pa
import pytest

import corpus_pipeline as pipeline

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_hand_over_few_rows(spark, monkeypatch):
    def sized(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get(SETTING)
    monkeypatch.setattr(pipeline.secret_scan, "redact", lambda docs: docs.mapInArrow(sized, "n bigint"))
    made = pipeline.redact_secrets(spark, spark.range(0, 4_500, 1, 1), "")
    assert sorted(r[0] for r in made.collect()) == [500, 1_000, 1_000, 1_000, 1_000]
    assert spark.conf.get(SETTING) == before
    with pytest.raises(ZeroDivisionError):
        pipeline.in_small_batches(spark, lambda: 1 / 0)
    assert spark.conf.get(SETTING) == before
