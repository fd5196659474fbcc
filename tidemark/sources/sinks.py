"""Memory, run and audit tables on Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.sources.known import append_filter


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    return read_commits(spark, path).drop("added")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """The memories with the commit that added them, which is a folder of the store."""
    return spark.read.schema(T.StructType([*schemas.MEMORIES.fields, T.StructField("added", T.StringType())])).parquet(path)


def filter_path(path: str) -> str:
    """Where a store keeps the filters over its hashes."""
    return f"{path}-known"


def memory_rows(committed: DataFrame) -> DataFrame:
    """Committed items as store rows; columns an item lacks get their defaults."""
    have = set(committed.columns)
    defaults = {
        "project": F.lit(None), "session_id": F.lit(None), "created_at": F.current_timestamp(),
        "accessed_at": F.current_timestamp(), "access_count": F.lit(0), "metadata": F.create_map(),
    }
    return committed.select(*[
        (F.col(f.name) if f.name in have else defaults[f.name]).cast(f.dataType).alias(f.name)
        for f in schemas.MEMORIES.fields
    ])


def append_memories(committed: DataFrame, path: str) -> None:
    """Append items that committed_memories found to be new. They are read three times; stage them.

    One folder per commit and category; within a file rows are sorted by hash and carry a Bloom
    filter on it, so a later look-up of few hashes skips most row groups. The commit's filter is
    written first: if the rows then fail, it names hashes that nobody holds, which costs a look but
    hides no memory.
    """
    added = uuid.uuid4().hex
    append_filter(committed.select("commit_hash"), filter_path(path), added)
    (
        memory_rows(committed)
        .withColumn("added", F.lit(added))
        .hint("rebalance")
        .sortWithinPartitions("category", "commit_hash")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#commit_hash", "true")
        .partitionBy("added", "category")
        .parquet(path)
    )


def append_runs(summary: DataFrame, path: str) -> None:
    """S6."""
    have = set(summary.columns)
    defaults = {
        "project": F.lit(None), "session_id": F.lit(None),
        "duration_ms": F.lit(None), "created_at": F.current_timestamp(),
    }
    summary.select(*[
        (F.col(f.name) if f.name in have else defaults[f.name]).cast(f.dataType).alias(f.name)
        for f in schemas.RUNS.fields
    ]).write.mode("append").parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Timestamped, tagged events."""
    stamped = rows if "ts" in rows.columns else rows.withColumn("ts", F.current_timestamp())
    stamped.select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.AUDIT.fields], F.to_date("ts").alias("date")
    ).write.mode("append").partitionBy("date").parquet(path)
