"""Source files of a project, and their tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.frontend.builder import build_bytes, build_file, problem
from tidemark.functions.text import path_matches
from tidemark.plans.model import SCHEMAS, Graph, scratch_folder, shuffled

#: What is scanned and what never is.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
DECLARATIONS = (".d.ts", ".d.mts", ".d.cts")
EXCLUDED = ("node_modules", "dist", "build", "coverage", "out", ".git", ".next", ".nuxt", ".turbo", ".cache", "vendor", "**/*.min.js", "**/*.bundle.js", "**/node_modules/**", "**/dist/**")

ALIASES = "scope string, name string, chain string, seq int"


@dataclass(frozen=True)
class Selection:
    """Which files of a tree are wanted: an extension, no declaration, no excluded pattern, one of the included ones if there are any."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = EXCLUDED
    extensions: tuple[str, ...] = EXTENSIONS

    @classmethod
    def of(cls, include: list[str] | None, exclude: list[str] | None, extensions: tuple[str, ...] = EXTENSIONS) -> Selection:
        return cls(tuple(include or ()), (*EXCLUDED, *(exclude or ())), tuple(extensions))

    def takes(self, path: str) -> bool:
        return path.endswith(self.extensions) and not path.endswith(DECLARATIONS) and not path_matches(path, self.exclude) and (not self.include or path_matches(path, self.include))


def entries(root: str, folder: str, wanted: Selection) -> Iterator[tuple[str, str, str | None]]:
    """kind (folder, file or error), path below the root with /, message: what is wanted directly in a folder, in no order. Links aren't followed; a folder that can't be listed and a name that isn't UTF-8 are errors."""
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for e in found:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_symlink():
                    continue
                kind = "folder" if e.is_dir() else "file"
                if path_matches(path, wanted.exclude) if kind == "folder" else not (wanted.takes(path) and e.is_file()):
                    continue
                plain = path.encode("utf-8", "replace").decode()
                yield ("error", plain, "its name isn't UTF-8") if plain != path else (kind, path, None)
    except OSError as e:
        yield "error", folder, f"can't list: {e.strerror or e}"


def folder_of(root: str) -> str:
    """The folder that a root's paths are relative to."""
    root = os.path.abspath(root)
    return root if os.path.isdir(root) else os.path.dirname(root)


def missing(root: str) -> list[dict]:
    return [] if os.path.exists(root) else [problem(f"no such file or folder: {root}", root)]


def discover_files(root: str, include: list[str] | None = None, exclude: list[str] | None = None, extensions: tuple[str, ...] = EXTENSIONS, files: list[str] | None = None) -> tuple[list[str], list[dict]]:
    """Sorted absolute paths, and diagnostics. Excluded folders aren't entered, links aren't followed; a root that is a file stands for itself."""
    if files is not None:
        return sorted(os.path.abspath(f) for f in files), []
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        return [root] if os.path.exists(root) else [], missing(root)
    wanted, pending, found, said = Selection.of(include, exclude, extensions), [""], [], []
    while pending:
        for kind, path, message in entries(root, pending.pop(), wanted):
            if kind == "folder":
                pending.append(path)
            elif kind == "file":
                found.append(os.path.join(root, path))
            else:
                said.append(problem(message, os.path.join(root, path) if path else root))
    return sorted(found), sorted(said, key=lambda d: d["file"])


def unopened(file: str) -> str | None:
    """Why a file can't be opened, if it can't."""
    try:
        with open(file, "rb"):
            return None
    except OSError as e:
        return f"can't read: {e.strerror or e}"


def readable(files: list[str]) -> tuple[list[str], list[dict]]:
    """Files that can be opened, and an error for each other one, for whatever reads them afterwards."""
    tried = [(f, unopened(f)) for f in files]
    return [f for f, why in tried if why is None], [problem(why, f) for f, why in tried if why is not None]


#: The tables that a file leaves, as one struct column each.
TABLES = {n: SCHEMAS[n] for n in ("functions", "nodes", "edges", "call_sites", "callback_links", "diagnostics")} | {"aliases": ALIASES}


#: Files whose rows a parsing task holds at once.
FILES = 500


def _parsed(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """files (relative_path, and content or text) -> kind, and a struct column for each of the named tables: the row is in that of its kind. Files are parsed one by one in parallel, however few partitions they come in."""
    held = StructType([StructField("kind", StringType()), *[StructField(n, StructType.fromDDL(TABLES[n])) for n in names]])
    arrow = to_arrow_schema(held)
    source = "content" if "content" in files.columns else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, FILES) for b in batches for i in range(0, b.num_rows, FILES)):
            made: dict[str, list[dict]] = {n: [] for n in TABLES}
            for path, data, why in zip(*(batch.column(c).to_pylist() for c in ("relative_path", source, "unread")), strict=True):
                if why is not None:
                    made["diagnostics"].append(problem(why, path))
                    continue
                for n, rows in (build_bytes(data, path) if isinstance(data, bytes) else build_file(data or "", path)).items():
                    made[n] += rows
            for n in names:
                if rows := made[n]:
                    own = [pa.array(rows, f.type) if f.name == n else pa.nulls(len(rows), f.type) for f in list(arrow)[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(rows)), *own], schema=arrow)

    # Parsing costs more than moving a file's text.
    unread = F.col("unread") if "unread" in files.columns else F.lit(None).cast("string").alias("unread")
    dealt = files.select("relative_path", source, unread).repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "relative_path")
    return dealt.mapInArrow(run, held)


def function_table(files: DataFrame) -> DataFrame:
    """The functions of graph_tables alone, not written first: no row of another table leaves the parser."""
    return _parsed(files, ("functions",)).select("functions.*")


def graph_tables(files: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """files (relative_path, and content or text) -> the graph, aliases, diagnostics. A file that can't be parsed leaves an error.

    A column `unread` says of a file why it couldn't be read after it was found; its message is an error then, and nothing else comes of it.

    Rows leave the parser with their types, in a struct column for each table, and are written once, a folder for each table, so that later reads take the columns they need and know the sizes.
    """
    spark = files.sparkSession
    rows = _parsed(files, tuple(TABLES))
    folder = scratch_folder(spark, "graph")
    rows.write.partitionBy("kind").parquet(folder)
    table = lambda n: shuffled(spark.read.schema(rows.schema).parquet(folder).where(F.col("kind") == n).select(f"{n}.*"))
    return Graph(*[table(n) for n in ("functions", "nodes", "edges", "call_sites", "callback_links")]), table("aliases"), table("diagnostics")
