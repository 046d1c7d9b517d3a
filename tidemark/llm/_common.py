"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.model import checkpointed, ensure_checkpoint_dir  # noqa: F401  (shared with the core)

#: UTF-8 bytes of text that one Python step handles at once; a longer text is a step of its own.
SLICE_BYTES = 2 << 20

#: Bytes that end a word: space and 0x09 to 0x0D, which is also what bytes.split() takes as white space.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label may be learnt from: crc32 of the id's decimal text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles nothing refers to any more, so that their files go now and not at the driver's next full collection."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about limit bytes of the column at most, but one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes, a null as an empty text."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, keep: list[str], compute: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Narrow to keep and text, and run compute over bounded slices; it returns the columns of schema as arrays or lists."""
    spark_schema = df.select(*keep, "text").schema
    out_schema = _parse(df.sparkSession, schema)
    fields = pa.schema([(f.name, _arrow(f.dataType)) for f in out_schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = compute(part)
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if not isinstance(found[f.name], pa.Array) else found[f.name].cast(f.type) for f in fields], schema=fields)

    return df.select(*[F.col(c) for c in spark_schema.names]).mapInArrow(run, out_schema)


def _parse(spark: SparkSession, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def smallest_hashes(df: DataFrame, key: str, n: int, seed: int, *more: str) -> DataFrame:
    """At most n rows of key and more, those with the smallest seeded hash of key: a bounded sample that reruns repeat."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    return df.select(key, *more).orderBy(h, key).limit(n)


#: Ids (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id is in ids (doc_id), null meeting null: the ids are broadcast if they are few, and shuffled with docs otherwise."""
    ids = checkpointed(ids.select(F.col("doc_id").alias("_gone")).distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["_gone"]), "left_anti")
