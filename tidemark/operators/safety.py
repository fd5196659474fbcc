"""Safety operators over tables of messages and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import safety as S
from tidemark.functions.text import pattern


def safety_hits(messages: DataFrame, text: str = "text") -> DataFrame:
    """X1, one row per match: message columns plus pattern_no and pattern.

    Ordered by (turn, pattern_no) these rows are the block list of a request, repeats included.
    They stay rows instead of one array per request, so that a request of any size stays spread
    over tasks.
    """
    return messages.select(
        *[c for c in messages.columns if c != text],
        F.posexplode(S.dangerous_hits(F.col(text))).alias("hit_no", "pattern"),
    )


def safety_verdicts(messages: DataFrame, request: str = "request_id", text: str = "text") -> DataFrame:
    """X1 per request: safe, number of matches, and matches per pattern.

    Each pattern gets one counter, so a request with any number of messages is summed map-side
    and no group is ever gathered.
    """
    counted = messages.groupBy(request).agg(*[
        F.count_if(S.is_dangerous(F.col(text), regex)).alias(f"_p{i}")
        for i, regex in enumerate(rules.DANGEROUS_PATTERNS)
    ])
    pairs = F.array(*[
        F.struct(F.lit(regex).alias("pattern"), F.col(f"_p{i}").alias("hits"))
        for i, regex in enumerate(rules.DANGEROUS_PATTERNS)
    ])
    hits = reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(rules.DANGEROUS_PATTERNS))])
    return counted.select(
        request,
        (hits == 0).alias("safe"),
        hits.alias("hits"),
        F.filter(pairs, lambda p: p["hits"] > 0).alias("blocked_patterns"),
    )


def scrub_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its scrubbed form and add changed. A NULL text counts as empty."""
    scrubbed = F.when(S.may_hold_credentials(F.col(text)), S.scrub(F.col(text))).otherwise(F.col(text))
    return (
        texts.withColumn(text, F.coalesce(text, F.lit("")))
        .withColumn("_scrubbed", scrubbed)
        .withColumn("changed", F.col("_scrubbed") != F.col(text))
        .withColumn(text, F.col("_scrubbed"))
        .drop("_scrubbed")
    )


def with_findings(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add findings: array of (kind, value) in rule order.

    As in X2, each rule looks at the text the earlier rules have already scrubbed, so a secret is
    found once, under the rule that removes it. Each rule is a projection over the one before, so
    no replacement is computed twice.
    """
    rest = texts.withColumn("_rest", F.col(text))
    found = []
    for i, rule in enumerate(rules.CREDENTIAL_RULES):
        kind, regex, flags, replacement, group = rule
        rest = rest.withColumn(f"_may{i}", S.may_match(F.col("_rest"), rule)).withColumns({
            f"_v{i}": F.when(
                F.col(f"_may{i}"), F.regexp_extract_all("_rest", F.lit(pattern(regex, flags)), F.lit(group))
            ).otherwise(F.array().cast("array<string>")),
            "_rest": F.when(
                F.col(f"_may{i}"), F.regexp_replace("_rest", pattern(regex, flags), replacement)
            ).otherwise(F.col("_rest")),
        }).drop(f"_may{i}")
        found.append(F.struct(F.lit(kind).alias("kind"), F.col(f"_v{i}").alias("values")))
    return rest.withColumn("findings", F.array(*found)).select(*texts.columns, "findings")


def secret_inventory(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per finding, value masked (X6) and hashed, with the placeholder flag."""
    held = texts.select(key, text).filter(S.may_hold_credentials(F.col(text)))
    # outer: a plain explode would be given a filter that computes the findings once more
    return (
        with_findings(held, text)
        .select(key, F.explode_outer("findings").alias("_f"))
        .select(key, "_f.kind", F.explode_outer("_f.values").alias("_value"))
        .filter(F.col("_value").isNotNull())
        .select(
            key,
            "kind",
            S.masked(F.col("_value")).alias("masked"),
            F.sha2("_value", 256).alias("value_hash"),
            S.is_placeholder(F.col("_value")).alias("placeholder"),
        )
    )


def secret_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("kind").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("placeholder").alias("placeholders")
    )


def shell_gate(commands: DataFrame, command: str = "command") -> DataFrame:
    """Add the matched rule and the blocked flag to shell commands."""
    return commands.withColumn("matched", S.shell_match(F.col(command))).withColumn(
        "blocked", F.col("matched").isNotNull()
    )


def blocked_audit(gated: DataFrame, command: str = "command") -> DataFrame:
    """S9 rows for blocked commands: the whole command, and the log line with its first bytes."""
    cut = F.make_valid_utf8(F.substring(F.col(command).cast("binary"), 1, rules.AUDIT_BYTES))
    return gated.filter("blocked").select(
        *[c for c in gated.columns if c not in ("matched", "blocked")],
        F.lit("safety").alias("tag"),
        F.concat(F.lit("BLOCKED command (matched: "), F.col("matched"), F.lit("): "), cut).alias("text"),
    )
