"""Provider and price tables."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark import rules, schemas


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A local relation: the planner knows its size exactly and broadcasts it by that."""
    arrow = to_arrow_schema(schemas.PROVIDERS)
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow))


def default_providers(spark: SparkSession) -> DataFrame:
    rows = [
        (name, model, Decimal(p_in), Decimal(p_out), tier, declared, chain)
        for name, model, _, p_in, p_out, tier, declared, chain in rules.PROVIDERS
    ]
    return _table(spark, rows)


def starter_providers(spark: SparkSession) -> DataFrame:
    rows = [
        (name, model, Decimal(p_in), Decimal(p_out), 1, pos, None)
        for pos, (name, model, _, p_in, p_out) in enumerate(rules.STARTER_PROVIDERS, start=1)
    ]
    return _table(spark, rows)


def providers_from_config(spark: SparkSession, config: dict) -> DataFrame:
    """A nested settings mapping (providers, failover_chain, extra_providers) as a table."""
    chain = {name: pos for pos, name in enumerate(config.get("failover_chain", []), start=1)}
    extra = config.get("extra_providers", {})
    rows = []
    for tier, entries in ((1, config.get("providers", {})), (2, extra)):
        for name, entry in entries.items():
            price = entry.get("cost_per_million", {})
            rows.append((
                name, entry.get("model", rules.UNKNOWN),
                Decimal(str(price.get("input", 0))), Decimal(str(price.get("output", 0))),
                tier, len(rows) + 1, chain.get(name) if tier == 1 else None,
            ))
    return _table(spark, rows)
