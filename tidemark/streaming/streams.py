"""Streaming jobs (T1-T6). Each takes a streaming DataFrame; the row-wise ones also run in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark import rules
from tidemark.functions import hooks as H
from tidemark.operators.attempts import breaker_state, failure_streaks
from tidemark.operators.extraction import model_extraction
from tidemark.operators.hooks import contexts_of, shell_commands
from tidemark.operators.ledger import gate_outcomes
from tidemark.operators.quality import score_texts
from tidemark.operators.safety import blocked_audit, scrub_texts
from tidemark.plans.jobs import commit_outputs
from tidemark.session import stage, staging
from tidemark.sources.cells import days_of, refresh_cells
from tidemark.sources.ledger import ledger_rows, read_ledger

STATE_SCHEMA = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("streak", T.LongType()),
    T.StructField("open_until_s", T.LongType()),
])


def gated_texts(texts: DataFrame, text: str = "text", threshold: float = rules.PASS_MARK) -> DataFrame:
    """Gate, then scrub what passed; rejected text stays as it was. Stateless."""
    scored = score_texts(texts, text, threshold).withColumn("_original", F.col(text))
    scrubbed = scrub_texts(scored, text)
    return (
        scrubbed.withColumn(text, F.when(F.col("passed"), F.col(text)).otherwise(F.col("_original")))
        .withColumn("changed", F.col("passed") & F.col("changed"))
        .drop("_original")
    )


def command_alerts(events: DataFrame) -> DataFrame:
    """Audit rows of blocked shell commands. Stateless."""
    return blocked_audit(shell_commands(events))


def rolling_cost_windows(
    ledger: DataFrame, lateness: str = "1 hour", width: str = "24 hours", slide: str = "1 hour"
) -> DataFrame:
    """Cost per provider and model in sliding windows; write with append mode.

    Windows move by the slide, so they approximate the exact cutoff of the batch report. Rows are
    first summed per slide; only those sums are copied into the windows they belong to, so a row
    is not multiplied by the number of overlapping windows. A window appears once the watermark
    has passed its end; rows later than that are dropped.
    """
    sums = ["requests", "tokens_in", "tokens_out", "cost_usd"]
    slides = (
        ledger.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", slide).alias("s"), "provider", "model")
        .agg(F.count(F.lit(1)).alias("requests"), *[F.sum(name).alias(name) for name in sums[1:]])
    )
    return (
        slides.groupBy(F.window(F.window_time("s"), width, slide).alias("w"), "provider", "model")
        .agg(*[F.sum(name).alias(name) for name in sums])
        .select("w.start", "w.end", "provider", "model", *sums)
    )


def cost_slides(ledger: DataFrame, lateness: str = "25 hours", slide: str = "1 hour") -> DataFrame:
    """Sums per slide, provider and model; write with update mode (slide_stream).

    A slide is updated until the watermark has passed it by the lateness; `windows_of` turns the
    written slides into windows, the open ones included.
    """
    return (
        ledger.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", slide).alias("s"), "provider", "model")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            *[F.sum(name).alias(name) for name in ("tokens_in", "tokens_out", "cost_usd")],
        )
        .select("s.start", "provider", "model", "requests", "tokens_in", "tokens_out", "cost_usd")
    )


def slide_stream(slides: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's changed slides to its own folder; a batch run again replaces its own."""

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        slides.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )


def windows_of(written: DataFrame, width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """T3 as a report over written slides (with batch_id): every window that holds one, closed or open.

    The newest version of each slide counts. Rows are slides, not requests.
    """
    sums = ["requests", "tokens_in", "tokens_out", "cost_usd"]
    newest = written.groupBy("start", "provider", "model").agg(F.max_by(F.struct(*sums), "batch_id").alias("x"))
    return (
        newest.groupBy(F.window("start", width, slide).alias("w"), "provider", "model")
        .agg(*[F.sum(f"x.{name}").alias(name) for name in sums])
        .select("w.start", "w.end", "provider", "model", *sums)
    )


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last complete result that snapshot_stream has written."""
    written = spark.read.parquet(path)
    return written.filter(F.col("batch_id") == written.agg(F.max("batch_id")).scalar()).drop("batch_id")


def gate_counters(ledger: DataFrame, threshold: float = rules.PASS_MARK) -> DataFrame:
    """Running counts of gate outcomes; write with complete or update mode."""
    return gate_outcomes(ledger, threshold)


def append_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet with all data available now, then stop."""
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).format("parquet").start(path)
    )


def snapshot_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each complete result of a small running aggregate to its own folder."""

    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )


def breaker_stream(
    attempts: DataFrame, path: str, state_path: str, checkpoint: str, cool_off: int = rules.COOL_OFF_SECONDS
) -> StreamingQuery:
    """T4: streaks and cool-offs over a stream of attempts.

    A keyed state function would put all attempts of a provider in one task per batch. Here each
    batch is a range-cut scan like the batch operator, started from the providers' state after
    the batch before. State and result of a batch go to folders named by its number, so a batch
    that is run again replaces its own output. Within a batch attempts are ordered by time; an
    attempt that arrives in a later batch counts after those already seen, as in a live breaker.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id:
            before = spark.read.schema(STATE_SCHEMA).parquet(f"{state_path}/batch_id={batch_id - 1}")
        with staging(spark):
            streaks = failure_streaks(batch, cool_off, before)
            streaks.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            written = spark.read.schema(streaks.schema).parquet(f"{path}/batch_id={batch_id}")
            after = breaker_state(written, cool_off).select(*STATE_SCHEMA.names)
            if before is not None:
                after = after.unionByName(before.join(after.select("provider"), "provider", "left_anti"))
            after.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")

    return (
        attempts.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(run).start()
    )


def ledger_stream(facts: DataFrame, path: str, checkpoint: str, cells_path: str | None = None) -> StreamingQuery:
    """Append the rows of `ledger_facts` to a ledger, their request_id as id.

    Each batch has a folder of its own, with one folder per day in it; a batch that runs again replaces its own.
    With cells_path the hour cells of the days it wrote are brought up to date.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = ledger_rows(batch.withColumnRenamed("request_id", "id")).withColumn("date", F.to_date("ts"))
        written = f"{path}/batch_id={batch_id}"
        rows.write.mode("overwrite").partitionBy("date").parquet(written)
        days = days_of(read_ledger(batch.sparkSession, written)) if cells_path else []
        if days:
            refresh_cells(read_ledger(batch.sparkSession, path), days, cells_path)

    return (
        facts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(run).start()
    )


def memory_stream(
    events: DataFrame,
    extract: Callable[[str, str], str],
    store_path: str,
    checkpoint: str,
    key: str = "event_id",
    runs_path: str | None = None,
    index_path: str | None = None,
) -> StreamingQuery:
    """T5: compaction and session-end events -> contexts -> extraction -> commit.

    events come from parse_payloads. A commit knows memories by hash, so a batch that is run
    again adds none. With index_path the new memories enter that search index.
    """
    event = F.col("event")
    keep = H.is_compaction(event) | H.has_session_end_content(event, F.col("payload"))
    contexts = contexts_of(events, keep).withColumnRenamed(key, "run_id")

    def run(batch: DataFrame, batch_id: int) -> None:
        with staging(batch.sparkSession):
            batch = stage(batch.select("run_id", "context", "project", "session_id"), "contexts")
            outputs = model_extraction(batch, extract).withColumn("run_part", F.lit(0))
            outputs = outputs.join(batch.select("run_id", "project", "session_id"), "run_id")
            commit_outputs(outputs, store_path, runs_path, keep=["project", "session_id"], index_path=index_path)

    return (
        contexts.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(run).start()
    )
