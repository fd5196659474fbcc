"""Request ledger reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import rules
from tidemark.functions.chat import baseline_cost


def latest_ts(ledger: DataFrame) -> datetime:
    """Time of the newest row: the as_of for a report over a closed log."""
    return ledger.agg(F.max("ts").alias("ts")).first()["ts"]


def cutoff_of(as_of: datetime | None, hours: int) -> Column:
    """The time that rows of a rolling report have to be after; a constant of the query."""
    end = F.current_timestamp() if as_of is None else F.lit(as_of)
    return end - F.make_interval(hours=F.lit(hours))


def rolling_window(
    ledger: DataFrame, as_of: datetime | None = None, hours: int = rules.ROLLING_HOURS
) -> DataFrame:
    """rows newer than as_of minus hours, the cutoff itself excluded.

    as_of becomes a constant of the column's own type, so the filter reaches the Parquet scan.
    With a date partition column the older folders are not opened at all.
    """
    cutoff = cutoff_of(as_of, hours)
    if isinstance(ledger.schema["ts"].dataType, T.TimestampNTZType):
        cutoff = cutoff.cast("timestamp_ntz")
    recent = ledger.filter(F.col("ts") > cutoff)
    return recent.filter(F.col("date") >= F.to_date(cutoff)) if "date" in ledger.columns else recent


def _exact(amount: Column, digits: int) -> Column:
    return F.round(amount, digits).cast("double")


_SUM_NAMES = [
    "requests", "tokens_in", "tokens_out", "cost", "quality", "latency", "successes", "failures", "rejections",
]


# Sums of every report, by name. They are exact (integers and decimals), so the order in which
# partial sums meet cannot change a result.
def sums(rows: DataFrame) -> list[Column]:
    """The sums over ledger rows, or over cells that hold them already (`sources/cells.py`)."""
    if "requests" in rows.columns:
        return [F.sum(name).alias(name) for name in _SUM_NAMES]
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("requests"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("cost"),
        F.sum(F.col("quality_score").cast("decimal(12,6)")).alias("quality"),
        F.sum("latency_ms").alias("latency"),
        F.count_if(status == "success").alias("successes"),
        F.count_if(status == "failed").alias("failures"),
        F.count_if(status == "rejected").alias("rejections"),
    ]


def usage_cells(window: DataFrame) -> DataFrame:
    """Sums per (provider, model, role): the grain all rolling reports are folded from."""
    return window.groupBy("provider", "model", "role").agg(*sums(window))


def _average(total: str, digits: int) -> Column:
    return F.round(F.col(total).cast("double") / F.col("requests"), digits)


def _provider_columns() -> list[Column]:
    return [
        F.col("requests"),
        F.col("tokens_in"),
        F.col("tokens_out"),
        _exact(F.col("cost"), 6).alias("cost_usd"),
        _average("quality", 3).alias("avg_quality"),
        _average("latency", 1).alias("avg_latency_ms"),
        F.col("successes"),
        F.col("failures"),
        F.col("rejections"),
    ]


def rolling_costs(window: DataFrame) -> DataFrame:
    """A1, O1: per (provider, model), dearest first."""
    return (
        window.groupBy("provider", "model")
        .agg(*sums(window))
        .orderBy(F.desc("cost"), "provider", "model")
        .select("provider", "model", *_provider_columns())
    )


def rolling_costs_by_role(window: DataFrame) -> DataFrame:
    """Per role, rows without a role left out."""
    return (
        window.filter(F.col("role").isNotNull())
        .groupBy("role")
        .agg(*sums(window)[:4])
        .orderBy(F.desc("cost"), "role")
        .select("role", "requests", _exact(F.col("cost"), 6).alias("cost_usd"), "tokens_in", "tokens_out")
    )


def savings_columns(price_in: str, price_out: str) -> list[Column]:
    """P9 over summed tokens and cost; the percentage is 0 for a baseline of 0."""
    baseline = baseline_cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out)
    saved = baseline - F.col("cost")
    return [
        _exact(F.col("cost"), 6).alias("total_cost_usd"),
        _exact(baseline, 4).alias("baseline_usd"),
        _exact(saved, 4).alias("savings_usd"),
        F.when(baseline > 0, F.round(saved.cast("double") / baseline.cast("double") * 100, 1))
        .otherwise(F.lit(0.0))
        .alias("savings_pct"),
    ]


def _totals(rows: DataFrame) -> DataFrame:
    totals = rows.agg(*sums(rows)[:4])
    return totals.select(*[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in totals.columns])


def rolling_totals(
    window: DataFrame,
    price_in: str = rules.BASELINE_PRICE_IN,
    price_out: str = rules.BASELINE_PRICE_OUT,
) -> DataFrame:
    """A2."""
    return _totals(window).select(*savings_columns(price_in, price_out))


def lifetime_savings(
    ledger: DataFrame,
    price_in: str = rules.BASELINE_PRICE_IN,
    price_out: str = rules.BASELINE_PRICE_OUT,
) -> DataFrame:
    """A4, F2: over successful requests; zeros for an empty ledger."""
    baseline = baseline_cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out)
    return _totals(ledger.filter(F.col("status") == "success")).select(
        F.col("requests").alias("total_requests"),
        F.col("tokens_in").alias("total_tokens_in"),
        F.col("tokens_out").alias("total_tokens_out"),
        _exact(F.col("cost"), 6).alias("actual_cost_usd"),
        _exact(baseline, 4).alias("baseline_usd"),
        _exact(baseline - F.col("cost"), 4).alias("total_saved_usd"),
    )


def cost_report(window: DataFrame) -> DataFrame:
    """A1, A2 and A3 from one scan: level is 'provider', 'role' or 'total'.

    The scan is summed once to a few cells; only those are expanded into the three groupings.
    """
    cells = usage_cells(window)
    grouped = cells.groupingSets(
        [[F.col("provider"), F.col("model")], [F.col("role")], []],
        F.col("provider"), F.col("model"), F.col("role"),
    ).agg(
        *[F.sum(name).alias(name) for name in _SUM_NAMES],
        F.grouping("provider").alias("_no_provider"),
        F.grouping("role").alias("_no_role"),
    )
    level = (
        F.when(F.col("_no_provider") == 0, "provider").when(F.col("_no_role") == 0, "role").otherwise("total")
    )
    return (
        grouped.withColumn("level", level)
        .filter((F.col("level") != "role") | F.col("role").isNotNull())
        .select("level", "provider", "model", "role", *_provider_columns())
    )


def gate_outcomes(ledger: DataFrame, threshold: float = rules.PASS_MARK) -> DataFrame:
    """A5: passed by quality, else rejected by status, else failed."""
    outcome = (
        F.when(F.col("quality_score") >= threshold, "passed")
        .when(F.col("status") == "rejected", "rejected")
        .otherwise("failed")
    )
    return ledger.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("requests"))
