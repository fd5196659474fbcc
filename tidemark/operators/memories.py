"""The memory store: commit, runs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import rules
from tidemark.functions.memory import memory_key
from tidemark.functions.text import base_name, snippet
from tidemark.session import stage

RUN_KEYS = ["run_id", "run_part"]


def with_key(items: DataFrame) -> DataFrame:
    return items.withColumn(
        "commit_hash", memory_key(F.col("category"), F.col("subcategory"), F.col("content"))
    )


def first_of_each(items: DataFrame, order: list[str]) -> DataFrame:
    """Of the items with one commit_hash the first in order.

    min over a struct is combined map-side, so a text that makes up a third of all items reaches
    the shuffle as one row per task. A window would gather all its copies in one task.
    """
    others = [c for c in items.columns if c not in ("commit_hash", *order)]
    return (
        items.groupBy("commit_hash")
        .agg(F.min(F.struct(*order, *others)).alias("_first"))
        .select("commit_hash", "_first.*")
    )


def unknown_to(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items whose hash the store does not hold. Only the hash column of it is read."""
    return items.join(store.select("commit_hash"), "commit_hash", "left_anti")


def committed_memories(
    items: DataFrame,
    store: DataFrame | None = None,
    threshold: int = rules.IMPORTANCE_THRESHOLD,
    order: list[str] | None = None,
) -> DataFrame:
    """The items that a run over all of them commits."""
    order = order or [*RUN_KEYS, "cat_order", "pos"]
    important = with_key(items.filter(F.col("importance") >= threshold))
    first = first_of_each(important, order)
    return first if store is None else unknown_to(first, store)


def run_summary(
    outputs: DataFrame, items: DataFrame, committed: DataFrame,
    max_chars: int | None = None,
) -> DataFrame:
    """Per run the context length after the cut, items extracted and items committed.

    Each side is summed to one row per run before the join, so a large run stays small there;
    runs without items keep their row.
    """
    runs = outputs.groupBy(*RUN_KEYS).agg(
        (F.max("context_length") if max_chars is None else F.least(F.max("context_length"), F.lit(max_chars)))
        .cast("long").alias("context_length")
    )
    extracted = items.groupBy(*RUN_KEYS).agg(F.count(F.lit(1)).alias("extracted"))
    kept = committed.groupBy(*RUN_KEYS).agg(F.count(F.lit(1)).alias("committed"))
    return (
        runs.join(extracted, RUN_KEYS, "left")
        .join(kept, RUN_KEYS, "left")
        .withColumns({
            "extracted": F.coalesce("extracted", F.lit(0)),
            "committed": F.coalesce("committed", F.lit(0)),
        })
    )


def project_label(project: Column) -> Column:
    """P16."""
    return F.coalesce(project, F.lit(rules.UNASSIGNED))


def memory_stats(memories: DataFrame) -> DataFrame:
    """The total and the count per category, as (section, name, memories)."""
    return memories.rollup("category").agg(
        F.count(F.lit(1)).alias("memories"), F.grouping("category").alias("_all")
    ).select(
        F.when(F.col("_all") == 1, "total").otherwise("category").alias("section"),
        F.when(F.col("_all") == 1, "all").otherwise(F.col("category")).alias("name"),
        "memories",
    )


def top_projects(memories: DataFrame, limit: int = 20) -> DataFrame:
    """The projects with most memories."""
    return (
        memories.groupBy(project_label(F.col("project")).alias("project"))
        .agg(F.count(F.lit(1)).alias("memories"))
        .orderBy(F.desc("memories"), "project")
        .limit(limit)
    )


def recent_runs(runs: DataFrame, order: list[str], limit: int = 10) -> DataFrame:
    """The latest runs; a top-k over partitions, not a full sort."""
    return runs.orderBy(*[F.desc(c) for c in order]).limit(limit)


def recent_memories(memories: DataFrame, created: str, key: str, limit: int = 5) -> DataFrame:
    """Per project the latest memories as printable snippets.

    Spark keeps the best rows of each project per task before the shuffle, so a project with most
    of the memories does not gather in one task.
    """
    newest = Window.partitionBy("project").orderBy(F.desc(created), F.desc(key))
    return (
        memories.filter(F.col("project").isNotNull())
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") <= limit)
        .select(
            "project",
            base_name(F.col("project")).alias("project_name"),
            "place",
            key,
            F.concat(F.lit("["), F.upper("category"), F.lit("] "), snippet(F.col("content"))).alias("line"),
        )
    )


def touched(memories: DataFrame, hits: DataFrame, key: str = "mem_id", at: Column | None = None) -> DataFrame:
    """The memories after a search: each hit adds one to access_count and sets accessed_at.

    Hits are summed and written first. There are at most queries times limit of them, and with
    their size known they are broadcast while small, so that the memories are not shuffled. The
    result is a new snapshot; write it to a new path and switch readers over, never onto its own
    input.
    """
    counts = stage(hits.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("_hits")), "touched")
    joined = memories.join(counts, key, "left")
    out = joined.withColumn("access_count", F.col("access_count") + F.coalesce("_hits", F.lit(0)))
    if at is not None:
        before = F.col("accessed_at") if "accessed_at" in memories.columns else F.lit(None).cast("timestamp")
        out = out.withColumn("accessed_at", F.when(F.col("_hits").isNotNull(), at).otherwise(before))
    return out.drop("_hits")
