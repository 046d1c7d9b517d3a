"""Tables of the data model. Ranges are one struct of 1-based start and end positions, the end exclusive."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast, lit
from pyspark.sql.types import StructType

RANGE = "struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>"
SCHEMAS = {
    "functions": f"id string, name string, class_name string, file string, range {RANGE}, params array<struct<name:string,index:int,optional:boolean,rest:boolean,destructured:array<string>>>, body_range {RANGE}, callees array<string>, analysable boolean, is_module_scope boolean",
    "nodes": f"id string, seq int, kind string, function_id string, range {RANGE}, label string, resolved_callees array<string>, text string",
    "edges": "src string, dst string, kind string, arg_index int",
    "call_sites": f"node_id string, caller_id string, callee_ids array<string>, text string, range {RANGE}",
    "callback_links": "call_node_id string, arg_node_id string, param_node_id string, return_node_id string",
    "sources": f"node_id string, source_id string, kinds array<string>, function_id string, range {RANGE}, label string",
    "sanitizers": f"node_id string, sanitizer_id string, kinds array<string>, valid boolean, invalid_reason string, function_id string, range {RANGE}",
    "sinks": f"node_id string, sink_id string, kinds array<string>, severity string, message string, advice string, cwe array<string>, function_id string, range {RANGE}, label string, tainted_args array<int>",
    "diagnostics": f"level string, message string, file string, range {RANGE}",
}


@dataclass
class Graph:
    functions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    call_sites: DataFrame
    callback_links: DataFrame


@dataclass
class Occurrences:
    sources: DataFrame
    sanitizers: DataFrame
    sinks: DataFrame


@dataclass(frozen=True)
class SolveOptions:
    """max_iterations bounds the states expanded for each function; max_call_depth the re-entries of a function on a path, 0 for no bound.

    ordered keeps the order of arrival, which decides about paths, budgets and ties; the set of states does without where no bound is met, and saves a sort a level.
    """

    max_iterations: int = 50_000
    max_call_depth: int = 5
    dedupe: bool = True
    kinds: tuple[str, ...] | None = None
    seed_params: bool = False
    scope_function: str | None = None
    ordered: bool = True
    source_notes: dict[str, str] = field(default_factory=dict)


def empty(spark: SparkSession, name: str) -> DataFrame:
    """No rows, of which the planner knows: what is joined with them is not read."""
    return spark.range(0).select(*[lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])]).where(lit(False))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder that spark.checkpoint.dir names; a temporary one on local masters that name none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name within the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder: lineage ends here and lost executors cost no recomputation.

    A checkpoint keeps its plan's estimate of size, which joins multiply, so that after some rounds of a loop the planner multiplies numbers of millions of
    bits. The table is therefore made anew from the checkpoint's rows and schema, with the default estimate; adaptive execution goes by real sizes.

    The shuffles that made the rows go at once, where else they would fill disks until the driver happens to collect its garbage. Should df be used again, Spark makes them again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint()._jdf
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The table, marked to be broadcast if it has few rows: a join with it then deals out nothing by keys that may be few."""
    return broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """The table, read from files, marked to be dealt out by key in joins. Spark takes the bytes of files for the size of their rows, of which ids that repeat each other are many times as many, and would gather such a table in the driver for a broadcast."""
    return df.hint("merge")


def let_go(spark: SparkSession) -> None:
    """Ask the driver's JVM for a collection: what nothing refers to any more goes now, with its shuffle files and the classes that plans were compiled to, which else pile up beside the heap over a loop's many plans."""
    spark.sparkContext._jvm.System.gc()


def estimated_bits(df: DataFrame) -> int:
    """How many bits the planner's estimate of a table's bytes has."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
