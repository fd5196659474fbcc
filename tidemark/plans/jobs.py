"""Jobs that write: committing memories and touching them after a search."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import rules, schemas
from tidemark.operators.extraction import parsed_items
from tidemark.operators.memories import RUN_KEYS, committed_memories, run_summary
from tidemark.operators.search import append_to_index
from tidemark.session import stage
from tidemark.sources.known import may_know, read_filters
from tidemark.sources.sinks import append_memories, append_runs, filter_path, memory_rows, read_commits


def new_to_store(first: DataFrame, store: DataFrame, filters: DataFrame) -> DataFrame:
    """J2 for a batch that is much smaller than the store: the items whose hash it does not hold.

    The commits' filters name the folders that may know a hash. Only these are read, and of them only
    row groups whose hashes may match; what the store really holds decides.
    """
    candidates = stage(may_know(first.select("commit_hash"), filters), "candidates")
    # Spark prunes folders at run time only for a join side that a comparison filters.
    candidates = candidates.where(F.length("added") > 0)
    known = store.select("added", "commit_hash").join(candidates, ["added", "commit_hash"], "left_semi")
    return first.join(known, "commit_hash", "left_anti")


def commit_outputs(
    outputs: DataFrame,
    store_path: str,
    runs_path: str | None = None,
    threshold: int = rules.IMPORTANCE_THRESHOLD,
    keep: list[str] | None = None,
    index_path: str | None = None,
) -> DataFrame:
    """E4 from model outputs on: parse, threshold, dedupe, append, log the runs.

    Running it again with the same outputs appends nothing, neither memories nor runs: a run is
    logged once, under its id. keep names run columns (project, session_id, ...) that the memories
    take over. With index_path the new memories enter that search index (key commit_hash). Needs
    a single writer per store: Parquet has no merge. Returns the committed memories.
    """
    started = time.monotonic()
    spark = outputs.sparkSession
    outputs = stage(outputs, "outputs")
    items = stage(parsed_items(outputs), "items")
    first = stage(committed_memories(items, threshold=threshold), "first")
    if path_exists(spark, store_path):
        store = read_commits(spark, store_path)
        if path_exists(spark, filter_path(store_path)):
            first = stage(new_to_store(first, store, read_filters(spark, filter_path(store_path))), "new")
        elif not store.isEmpty():
            raise ValueError(f"{store_path} has no filters; write its memories to a new store with append_memories")
    summary = run_summary(outputs, items, first)
    extra = [c for c in (keep or []) if c in outputs.columns]
    new = first.select("commit_hash", "category", "subcategory", "content", "importance", *extra)
    append_memories(new, store_path)
    if index_path:
        append_to_index(memory_rows(new), index_path, key="commit_hash")
    if runs_path:
        run_id = F.concat_ws("/", *[F.col(k).cast("string") for k in RUN_KEYS])
        summary = summary.withColumn("run_id", run_id)
        if path_exists(spark, runs_path):
            logged = spark.read.schema(schemas.RUNS).parquet(runs_path).select("run_id")
            summary = summary.join(logged, "run_id", "left_anti")
        # The runs of one call share its time: they were handled by the same jobs.
        took = int(1000 * (time.monotonic() - started))
        append_runs(summary.withColumn("duration_ms", F.lit(took)), runs_path)
    return first


def log_access(hits: DataFrame, path: str, key: str = "mem_id") -> None:
    """Append one row per memory found; the memories themselves are not rewritten."""
    hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits")).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def with_access(memories: DataFrame, accesses: DataFrame, key: str = "mem_id") -> DataFrame:
    """R5 at reading time: access_count and accessed_at with all logged accesses folded in."""
    found = accesses.groupBy(key).agg(F.sum("hits").alias("_hits"), F.max("at").alias("_at"))
    before = F.col("accessed_at") if "accessed_at" in memories.columns else F.lit(None).cast("timestamp")
    return (
        memories.join(found, key, "left")
        .withColumn("access_count", (F.col("access_count") + F.coalesce("_hits", F.lit(0))).cast("int"))
        .withColumn("accessed_at", F.coalesce("_at", before))
        .drop("_hits", "_at")
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
