"""Tables in the shared folder that stay dealt out by key, so that a loop joins them without shuffling them again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.model import ensure_checkpoint_dir, shuffled


class Store:
    """Bucketed tables in a folder of their own within that of spark.checkpoint.dir. What was written is read again if an executor is lost; files stay until that folder is cleared."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.id = spark, uuid.uuid4().hex
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/tables-{self.id}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.kept: dict[str, tuple[str, ...]] = {}
        self.seen: dict = {}

    def _full(self, name: str) -> str:
        return f"tidemark_{self.id}_{name}"

    def append(self, name: str, rows: DataFrame, by: tuple[str, ...], level: str | None = None, **more: Column) -> int:
        """Write rows to their buckets, those of a level in a folder of their own, and count them in the same job, in which `more` is aggregated, too, into `seen`."""
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]).write.format("parquet").mode("append").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, *by)
        (writer.partitionBy(level) if level else writer).saveAsTable(self._full(name))
        self.kept[name] = by
        self.seen = seen.get
        return self.seen["n"]

    def table(self, name: str) -> DataFrame:
        """All rows of a table, dealt out by its key."""
        return shuffled(self.spark.table(self._full(name)))

    def released(self, name: str) -> DataFrame:
        """The table's rows from its files; its name goes from the session's catalogue."""
        schema = self.table(name).schema
        self.drop(name)
        return shuffled(self.spark.read.schema(schema).parquet(f"{self.folder}/{name}"))

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._full(name)}")
