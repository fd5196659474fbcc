"""Ledger table on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas

_READ_SCHEMA = T.StructType([*schemas.LEDGER.fields, T.StructField("date", T.DateType())])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All ledger columns; files written before role existed read it as NULL.

    The schema is given, so no footers are opened to merge schemas.
    """
    return spark.read.schema(_READ_SCHEMA).parquet(path)


def ledger_rows(records: DataFrame) -> DataFrame:
    """Records as ledger rows: a new id where none is given, the time now where ts is absent, NULL for no role."""
    have = set(records.columns)
    return records.withColumns({
        "id": F.col("id") if "id" in have else F.expr("uuid()"),
        "ts": F.col("ts").cast("timestamp") if "ts" in have else F.current_timestamp(),
        "role": F.col("role") if "role" in have else F.lit(None).cast("string"),
    }).select(*[F.col(f.name).cast(f.dataType) for f in schemas.LEDGER.fields])


def append_ledger(records: DataFrame, path: str) -> None:
    """Append, one folder per day.

    The rebalance hint gathers each day into few files and lets adaptive execution split a day
    that holds most of the rows over many tasks.
    """
    rows = ledger_rows(records).withColumn("date", F.to_date("ts"))
    rows.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)
