"""Messages and responses as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import chat as C
from tidemark.functions.quality import gate_columns
from tidemark.operators.safety import scrub_texts


def flatten_messages(messages: DataFrame, content: str = "content") -> DataFrame:
    """Role and plain text of each message."""
    return messages.withColumns({
        "role": F.coalesce("role", F.lit("user")),
        "text": C.flatten_content(C.content_variant(F.col(content))),
    }).drop(content)


def prepend_system(messages: DataFrame, prompts: DataFrame, request: str = "request_id") -> DataFrame:
    """Flattened messages plus one system row per request, before its first turn.

    prompts holds JSON content per request. An empty string or a list without text adds no row.
    """
    content = C.content_variant(F.col("content"))
    is_list = C.blocks(content).isNotNull()
    rows = (
        prompts.withColumns({"_parts": F.size(C.text_blocks(content)), "text": C.flatten_content(content), "_list": is_list})
        .filter(F.when(F.col("_list"), F.col("_parts") > 0).otherwise(F.col("text") != ""))
        .select(request, F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), "text")
    )
    return messages.select(request, "turn", "role", "text").unionByName(rows)


def canonical_responses(
    responses: DataFrame, response: str = "response", threshold: float = rules.PASS_MARK
) -> DataFrame:
    """Gate, scrub, convert and count one stored response per row.

    The gate sees the text before scrubbing; only passed responses are scrubbed.
    """
    parsed = (
        responses.withColumn("_r", C.parse_response(F.col(response)))
        .withColumn("_text", C.response_text(F.col("_r")))
        .withColumn("_raw", gate_columns(F.col("_text")).raw_score)
    )
    scrubbed = scrub_texts(parsed.withColumn("_clean", F.col("_text")), "_clean")
    passed = F.col("_raw") >= threshold
    return (
        scrubbed.withColumn(
            "_r",
            F.when(passed & F.col("changed"), C.replace_text(F.col("_r"), F.col("_clean"))).otherwise(F.col("_r")),
        )
        .withColumns({
            "message": C.to_block_response(F.col("_r")),
            "passed": passed,
            "score": F.round("_raw", 3),
            "scrubbed": passed & F.col("changed"),
        })
        # A passed reply is counted in the form it was converted to, a rejected one as it came.
        .withColumns({
            f"tokens_{end}": F.when(F.col("passed"), F.col(f"message.usage.{kind}_tokens")).otherwise(C.usage_tokens(F.col("_r"), kind))
            for end, kind in (("in", "input"), ("out", "output"))
        })
        .drop("_r", "_text", "_raw", "_clean", "changed", response)
    )
