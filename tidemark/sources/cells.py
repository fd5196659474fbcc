"""Hour cells of a ledger, kept current day by day, so that reports need not read its rows (A1-A4).

A cell holds the exact sums of one (hour, provider, model, role, status). The table has one folder per
day. After rows are appended, only the days they fall on are summed again and replaced; doing that
twice changes nothing, so a batch that runs again is harmless.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators.ledger import cutoff_of, sums
from tidemark.session import stage
from tidemark.sources.ledger import append_ledger, ledger_rows, read_ledger

_KEYS = "hour timestamp, provider string, model string, role string, status string"
_SUMS = (
    "requests long, tokens_in long, tokens_out long, cost decimal(30,8), quality decimal(22,6), latency long, "
    "successes long, failures long, rejections long"
)
SCHEMA = f"{_KEYS}, {_SUMS}, date date"


def hour_cells(rows: DataFrame) -> DataFrame:
    """Ledger rows, which have a date, as cells."""
    return rows.groupBy(F.date_trunc("hour", "ts").alias("hour"), "provider", "model", "role", "status", "date").agg(*sums(rows))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def refresh_cells(ledger: DataFrame, days: list[dt.date], path: str) -> None:
    """Replace the cells of some days by the sums of the ledger's rows; other days stay untouched.

    The days are constants, so of the ledger only their folders are read. Needs one writer at a time.
    """
    cells = hour_cells(ledger.where(F.col("date").isin(days)))
    (
        cells.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date").parquet(path)
    )


def days_of(rows: DataFrame) -> list[dt.date]:
    """The days of ledger rows: at most one value per folder of the ledger."""
    return [r.date for r in rows.select("date").distinct().collect()]


def append_with_cells(records: DataFrame, ledger_path: str, cells_path: str) -> None:
    """S4 with upkeep: append records, then sum up again the days they fall on.

    If the job dies in between, run `refresh_cells` for these days, or append later rows of them.
    """
    rows = stage(ledger_rows(records), "ledger-rows")
    append_ledger(rows, ledger_path)
    refresh_cells(read_ledger(rows.sparkSession, ledger_path), days_of(rows.select(F.to_date("ts").alias("date"))), cells_path)


def rolling_cells(
    cells: DataFrame, ledger: DataFrame, as_of: dt.datetime | None = None, hours: int = rules.ROLLING_HOURS
) -> DataFrame:
    """F1 from cells: those of the whole hours after the cutoff, and the rest of the hour it falls in.

    Only for that hour are rows of the ledger read, from one day's folder. The result feeds the same
    reports as `rolling_window` and gives the same figures.
    """
    cutoff = cutoff_of(as_of, hours)
    whole = F.date_trunc("hour", cutoff) + F.make_interval(hours=F.lit(1))
    later = cells.where((F.col("date") >= F.to_date(cutoff)) & (F.col("hour") >= whole))
    border = ledger.where((F.col("date") == F.to_date(cutoff)) & (F.col("ts") > cutoff) & (F.col("ts") < whole))
    return later.unionByName(hour_cells(border))
