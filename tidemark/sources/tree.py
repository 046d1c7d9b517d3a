"""Trees of files as tables: listed level by level, each level's folders dealt anew among all tasks, and read as bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.model import checkpointed
from tidemark.sources.discovery import Selection, entries, folder_of, missing, unopened

LISTED = "kind string, path string, message string"
#: Rows of a batch that leaves a listing, and bytes of one that leaves a reader.
ROWS, BYTES = 10_000, 8 << 20


def list_tree(spark: SparkSession, root: str, wanted: Selection = Selection()) -> tuple[DataFrame, DataFrame]:
    """files (relative_path) and errors (file, message), paths relative to the root's folder: what discover_files and readable find, and they ask the same function about each folder.

    A level of folders is one job. Its folders are dealt among all tasks whatever folders they came from, so a deep or wide subtree is no one task's; excluded folders aren't entered. One folder's own entries are read by one task as a stream and leave it in
    batches. The levels are checkpoints, so lost executors cost no second listing of what is above them. All executors must see the root under one path. A root that isn't there gives one error, a file stands for itself, an empty folder gives no rows.
    """
    root = os.path.abspath(root)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([(c, pa.string()) for c in ("kind", "path", "message")])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
        for given in batches:
            for folder in given.column("path").to_pylist():
                for kind, path, message in entries(root, folder, wanted):
                    why = unopened(os.path.join(root, path)) if kind == "file" else None
                    rows.append((kind, path, message) if why is None else ("error", path, why))
                    if len(rows) == ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    if os.path.isdir(root):
        levels, above = [], spark.createDataFrame([("folder", "", None)], LISTED)
        while not levels or not above.isEmpty():
            level = checkpointed(above.select("path").repartition(parts).mapInArrow(listed, LISTED))
            levels.append(level)
            above = level.where("kind = 'folder'")
        found = reduce(DataFrame.unionByName, levels)
    else:
        why = next((d["message"] for d in missing(root)), None) or unopened(root)
        found = spark.createDataFrame([("file" if why is None else "error", os.path.basename(root), why)], LISTED)
    return found.where("kind = 'file'").select(F.col("path").alias("relative_path")), found.where("kind = 'error'").select(F.col("path").alias("file"), "message")


def read_tree(files: DataFrame, root: str) -> DataFrame:
    """relative_path, content, unread: whole files as bytes, or why one that was found can't be read any more. One file is one value, so a file and a batch of some megabytes are what a task holds."""
    base = folder_of(root)
    schema = pa.schema([("relative_path", pa.string()), ("content", pa.binary()), ("unread", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for given in batches:
            for path in given.column("relative_path").to_pylist():
                try:
                    with open(os.path.join(base, path), "rb") as source:
                        content = source.read()
                    rows.append((path, content, None))
                    size += len(content)
                except OSError as e:
                    rows.append((path, None, f"can't read: {e.strerror or e}"))
                if size >= BYTES or len(rows) == ROWS:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("relative_path").repartition(parts, "relative_path").mapInArrow(read, "relative_path string, content binary, unread string")


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write relative_path and text as files below a folder that all executors see; returns relative_path and bytes of each. A file gets its name once it is whole, so a task that runs again repeats it without harm. Files are dealt among all tasks, however few partitions they come in."""
    base = os.path.abspath(root)
    os.makedirs(base, exist_ok=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for batch in batches:
            sizes = []
            for path, text in zip(batch["relative_path"], batch["text"], strict=True):
                target = os.path.join(base, path)
                if (folder := os.path.dirname(target)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as out:
                    sizes.append(out.write((text or "").encode()))
                os.replace(part, target)
            yield pd.DataFrame({"relative_path": batch["relative_path"], "bytes": sizes})

    # Creating a file costs far more than moving its text.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(files.select("relative_path", "text").repartition(parts, "relative_path").mapInPandas(write, "relative_path string, bytes long"))


def local_path(uri: str) -> str:
    """A mounted folder's path, of its path or file: address; other file systems can't be listed this way."""
    scheme, found, rest = uri.partition(":/")
    if not found:
        return uri
    if scheme != "file":
        raise ValueError(f"{uri}: only mounted folders can be listed")
    return "/" + rest.lstrip("/")
