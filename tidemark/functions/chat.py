"""Message and response columns.

Message content arrives as JSON: a string, or a list of text blocks and bare strings. Responses
arrive as JSON in choices form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import rules

RESPONSE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ])),
        T.StructField("finish_reason", T.StringType()),
    ]))),
    T.StructField("usage", T.StructType([
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
    ])),
])


def content_variant(content_json: Column) -> Column:
    return F.try_parse_json(content_json)


def blocks(content: Column) -> Column:
    """Content as an array of blocks, NULL when it is not a list."""
    return F.try_variant_get(content, "$", "array<variant>")


def text_blocks(content: Column) -> Column:
    """Texts of the text blocks and bare strings of a content list, in order."""

    def text_of(block: Column) -> Column:
        kind = F.try_variant_get(block, "$.type", "string")
        return F.when(
            kind == "text", F.coalesce(F.try_variant_get(block, "$.text", "string"), F.lit(""))
        ).when(F.schema_of_variant(block) == "STRING", F.variant_get(block, "$", "string"))

    return F.array_compact(F.transform(blocks(content), text_of))


def flatten_content(content: Column) -> Column:
    """A string stays, a list becomes its texts joined by newlines, nothing becomes ''."""
    return F.when(
        blocks(content).isNotNull(), F.array_join(text_blocks(content), "\n")
    ).otherwise(F.coalesce(F.try_variant_get(content, "$", "string"), F.lit("")))


def parse_response(response_json: Column) -> Column:
    return F.from_json(response_json, RESPONSE_SCHEMA)


def first_choice(response: Column) -> Column:
    return F.try_element_at(response["choices"], F.lit(1))


def response_text(response: Column) -> Column:
    """P5: content of the first choice, '' when there is none."""
    return F.coalesce(first_choice(response)["message"]["content"], F.lit(""))


def replace_text(response: Column, text: Column) -> Column:
    """The response with text in its first choice; unchanged when that has no message."""
    changed = F.transform(
        response["choices"],
        lambda choice, i: F.when(
            (i == 0) & choice["message"].isNotNull(),
            choice.withField("message", choice["message"].withField("content", text)),
        ).otherwise(choice),
    )
    return F.when(response.isNotNull(), response.withField("choices", changed))


def finish_reason(reason: Column) -> Column:
    """P4."""
    out = F.lit("end_turn")
    for name, mapped in rules.FINISH_REASONS.items():
        if mapped != "end_turn":
            out = F.when(reason == name, mapped).otherwise(out)
    return out


def usage_tokens(response: Column, kind: str) -> Column:
    """Tokens of one kind, 'input' or 'output', under either of two names."""
    first, second = {
        "input": ("prompt_tokens", "input_tokens"),
        "output": ("completion_tokens", "output_tokens"),
    }[kind]
    usage = response["usage"]
    return F.coalesce(F.nullif(usage[first], F.lit(0)), usage[second], F.lit(0))


def to_block_response(response: Column) -> Column:
    """A choices-form response in content-block form."""
    choice = first_choice(response)
    usage = response["usage"]
    return F.struct(
        F.coalesce(response["id"], F.lit("")).alias("id"),
        F.lit("message").alias("type"),
        F.lit("assistant").alias("role"),
        F.array(
            F.struct(
                F.lit("text").alias("type"),
                F.coalesce(choice["message"]["content"], F.lit("")).alias("text"),
            )
        ).alias("content"),
        F.coalesce(response["model"], F.lit("")).alias("model"),
        finish_reason(choice["finish_reason"]).alias("stop_reason"),
        F.struct(
            F.coalesce(usage["prompt_tokens"], F.lit(0)).alias("input_tokens"),
            F.coalesce(usage["completion_tokens"], F.lit(0)).alias("output_tokens"),
        ).alias("usage"),
    )


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a request in exact decimals, 8 digits; a missing price counts as 0."""

    def side(tokens: Column, price: Column) -> Column:
        per_million = F.coalesce(price, F.lit(0)).cast("decimal(10,4)")
        return tokens.cast("decimal(18,0)") * per_million * F.lit("0.000001").cast("decimal(6,6)")

    return F.round(side(tokens_in, price_in) + side(tokens_out, price_out), 8).cast("decimal(20,8)")


def baseline_cost(
    tokens_in: Column,
    tokens_out: Column,
    price_in: str = rules.BASELINE_PRICE_IN,
    price_out: str = rules.BASELINE_PRICE_OUT,
) -> Column:
    """What the same tokens cost at the baseline price."""
    price = "decimal(10,4)"
    return token_cost(tokens_in, tokens_out, F.lit(price_in).cast(price), F.lit(price_out).cast(price))
