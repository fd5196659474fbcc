"""Text files and event payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import with_json


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one context; bytes that are not UTF-8 become replacement marks."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path"), F.make_valid_utf8(F.col("content")).alias("context")
    )


def parse_payloads(lines: DataFrame, raw: str = "payload") -> DataFrame:
    """Add event (VARIANT); NULL where the text is not a JSON object. Batch or stream."""
    # Other JSON than an object is no text to parse: so the value stays a plain column for the filters on it.
    return with_json(lines, F.when(F.col(raw).rlike(r"^\s*\{"), F.col(raw)), "event")


def readable(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event").isNotNull())


def quarantined(events: DataFrame) -> DataFrame:
    """Unreadable payloads, kept for the log."""
    return events.filter(F.col("event").isNull()).drop("event")


def read_payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """S8 as a stream of JSON lines."""
    return parse_payloads(spark.readStream.text(path).withColumnRenamed("value", "payload"))
