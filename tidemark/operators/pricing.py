"""Joins with the provider table.

The provider table comes from a settings file. No join here is told to broadcast: Catalyst
broadcasts a side whose size it knows to be below spark.sql.autoBroadcastJoinThreshold, which a
settings table always is, and uses a shuffle join beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import rules
from tidemark.functions.chat import token_cost


def price_table(providers: DataFrame, tier: int | None = None) -> DataFrame:
    """One price per provider; a name in several tiers takes the lowest."""
    rows = providers if tier is None else providers.filter(F.col("tier") == tier)
    return rows.groupBy("provider").agg(
        F.min_by("price_in", "tier").alias("price_in"), F.min_by("price_out", "tier").alias("price_out")
    )


def priced(requests: DataFrame, providers: DataFrame, tier: int | None = None) -> DataFrame:
    """Add cost_usd; a provider without a price costs 0."""
    return (
        requests.join(price_table(providers, tier), "provider", "left")
        .withColumn(
            "cost_usd",
            token_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")),
        )
        .drop("price_in", "price_out")
    )


def provider_for_model(
    requests: DataFrame, providers: DataFrame, model: str = "requested_model"
) -> DataFrame:
    """Add the provider that serves a requested model; the first declared one wins."""
    lookup = (
        providers.filter(F.col("tier") == 1)
        .groupBy(F.col("model").alias(model))
        .agg(F.min_by("provider", "declared_pos").alias("model_provider"))
    )
    return requests.join(lookup, model, "left")


def known_targets(requests: DataFrame, providers: DataFrame, target: str = "target_provider") -> DataFrame:
    """Requests whose named provider is configured in the first tier."""
    names = providers.filter(F.col("tier") == 1).select(F.col("provider").alias(target))
    return requests.join(names, target, "left_semi")


def unknown_targets(requests: DataFrame, providers: DataFrame, target: str = "target_provider") -> DataFrame:
    """J6, the complement: status unknown_provider."""
    names = providers.filter(F.col("tier") == 1).select(F.col("provider").alias(target))
    return requests.join(names, target, "left_anti").withColumn("status", F.lit("unknown_provider"))


def default_chain(providers: DataFrame, fallback: str = rules.FALLBACK_PROVIDER) -> DataFrame:
    """Providers by mean price, the fallback last, ties in declared order.

    The row number needs one ordered task; its input is the provider table, never a log.
    """
    mean = ((F.col("price_in") + F.col("price_out")) / 2).cast("double")
    is_last = (F.col("provider") == fallback).cast("int")
    order = Window.orderBy("_last", "_mean", "declared_pos")
    return (
        providers.withColumns({"_last": is_last, "_mean": F.when(is_last == 1, F.lit(0.0)).otherwise(mean)})
        .withColumn("chain_pos", F.row_number().over(order))
        .select("provider", "chain_pos", F.round("_mean", 4).alias("mean_price"))
    )
