"""From model outputs and contexts to memory items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import memory as M
from tidemark.functions.text import matches, strip, truncated, with_json


def category_order():
    return F.array_position(F.array(*[F.lit(c) for c in rules.CATEGORIES]), F.col("category")).cast("int")


def read_outputs(outputs: DataFrame) -> DataFrame:
    """Add items (array, NULL when the extractor failed) to each output row.

    An output is parsed, checked and normalised inside its own row, so losing an extractor's work
    over one bad item needs no shuffle.
    """
    return (
        with_json(outputs, M.json_array_text(F.col("output")), "_array")
        .withColumn("items", M.normalised_items(M.json_items(F.col("_array")), F.col("category")))
        .drop("_array", "output")
    )


def parsed_items(outputs: DataFrame) -> DataFrame:
    """One row per valid item; cat_order and pos give the order within a run."""
    read = read_outputs(outputs)
    return (
        # outer: a plain explode would be given a filter that computes the items once more
        read.select(*[c for c in read.columns if c != "items"], F.explode_outer("items").alias("_i"))
        .filter(F.col("_i").isNotNull())
        .withColumn("cat_order", category_order())
        .select("*", "_i.pos", "_i.content", "_i.importance", "_i.subcategory")
        .drop("_i")
    )


def failed_outputs(outputs: DataFrame) -> DataFrame:
    """Outputs lost to a bad item, for the log."""
    return read_outputs(outputs).filter(F.col("items").isNull()).drop("items")


def rule_facts(contexts: DataFrame, key: str = "context_id", text: str = "context") -> DataFrame:
    """E5: facts by pattern: addresses, dates, versions, settings, errors, numbers.

    A stand-in for a language model's extraction, not equal to it. Equal findings of a context
    count once. A pattern runs only over texts that hold a plain string each of its matches needs.
    """
    digits = F.col(text).rlike("[0-9]")
    may_hold = {
        "url": F.col(text).contains("://"),
        "date": digits & F.col(text).contains("-"),
        "version": digits & F.col(text).contains("."),
        "env_var": F.col(text).contains("_"),
        "setting": F.col(text).contains(" = "),
        "error": F.col(text).contains("Error: ") | F.col(text).contains("Exception: "),
        "number": digits,
    }

    def findings(kind: str, subcategory: str, importance: int, regex: str):
        hits = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0)))
        values = F.when(may_hold.get(kind, F.lit(True)), hits).otherwise(F.array().cast("array<string>"))
        return F.transform(values, lambda value: F.struct(
            F.lit(kind).alias("kind"), F.lit(subcategory).alias("subcategory"),
            F.lit(importance).cast("long").alias("importance"), value.alias("content"),
        ))

    found = F.flatten(F.array(*[findings(*rule) for rule in rules.FACT_RULES]))
    return (
        # outer: a plain explode would be given a filter that runs all patterns once more
        contexts.select(key, F.explode_outer(found).alias("_f"))
        .filter(F.col("_f").isNotNull())
        .select(key, F.lit("fact").alias("category"), "_f.*")
    )


def rule_sentences(contexts: DataFrame, key: str = "context_id", text: str = "context") -> DataFrame:
    """Sentences with a cue phrase, as decisions and skills. Also only a stand-in."""
    sentences = contexts.select(
        key, F.posexplode(F.split(F.col(text), r"[.!?\n]+")).alias("sentence_no", "_s")
    ).select(key, "sentence_no", strip(F.col("_s")).alias("content"))
    hit = F.coalesce(*[
        F.when(
            matches(F.col("content"), cue, "i"),
            F.struct(
                F.lit(category).alias("category"), F.lit(sub).alias("subcategory"),
                F.lit(importance).cast("long").alias("importance"),
            ),
        )
        for category, sub, importance, cue in rules.SENTENCE_RULES
    ])
    return (
        sentences.withColumn("_h", hit)
        .filter(F.col("_h").isNotNull())
        .select(key, "sentence_no", "_h.*", "content")
    )


def model_extraction(
    contexts: DataFrame,
    extract: Callable[[str, str], str],
    key: str = "run_id",
    text: str = "context",
    max_chars: int | None = None,
) -> DataFrame:
    """Run a caller's function (category, context) -> output text over all contexts.

    Every context gives one row per category. A call that fails gives an empty output, and its
    message in error (null otherwise), for S9. The result goes to read_outputs. Contexts arrive in
    Arrow batches; max_chars (P11) cuts them, by default they stay whole.
    """
    categories = list(rules.CATEGORIES)

    def outputs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(category: str, context: str) -> tuple[str, str | None]:
            try:
                return extract(category, context), None
            except Exception as error:
                return "", f"{type(error).__name__}: {error}"

        for rows in batches:
            for category in categories:
                called = [call(category, context) for context in rows[text]]
                yield pd.DataFrame({
                    key: rows[key],
                    "category": category,
                    "context_length": rows[text].str.len(),
                    "output": [output for output, _ in called],
                    "error": pd.Series([error for _, error in called], dtype="object"),
                })

    key_type = contexts.schema[key].dataType.simpleString()
    cut = contexts.select(key, truncated(F.col(text), max_chars).alias(text))
    return cut.mapInPandas(
        outputs_of, f"{key} {key_type}, category string, context_length long, output string, error string"
    )
