"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

LEDGER = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("tokens_in", T.LongType(), False),
    T.StructField("tokens_out", T.LongType(), False),
    T.StructField("cost_usd", T.DecimalType(20, 8), False),
    T.StructField("quality_score", T.DoubleType(), False),
    T.StructField("latency_ms", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("role", T.StringType(), True),
])

PROVIDERS = T.StructType([
    T.StructField("provider", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("price_in", T.DecimalType(10, 4), False),
    T.StructField("price_out", T.DecimalType(10, 4), False),
    T.StructField("tier", T.IntegerType(), False),
    T.StructField("declared_pos", T.IntegerType(), False),
    T.StructField("chain_pos", T.IntegerType(), True),
])

MEMORIES = T.StructType([
    T.StructField("commit_hash", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("subcategory", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("importance", T.LongType(), False),
    T.StructField("project", T.StringType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("accessed_at", T.TimestampType(), True),
    T.StructField("access_count", T.LongType(), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("project", T.StringType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("context_length", T.LongType(), False),
    T.StructField("extracted", T.LongType(), False),
    T.StructField("committed", T.LongType(), False),
    T.StructField("duration_ms", T.LongType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])

AUDIT = T.StructType([
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("tag", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
])
