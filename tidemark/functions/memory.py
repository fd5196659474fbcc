"""Memory item columns (E1-E3, P10, R5 helpers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.text import strip


def json_array_text(output: Column) -> Column:
    """The JSON array inside a model's output, '' when there is none.

    A leading code fence goes with its line, and so does everything from the last fence line on.
    What remains is cut from the first [ to the last ].
    """
    text = strip(output)
    body = F.regexp_replace(text, r"(?s)^[^\n]*(\n|\z)", "")
    body = F.regexp_replace(body, r"(?sU)^(.*\n|)[^\S\n]*```.*\z", "$1")
    unfenced = F.when(text.startswith("```"), body).otherwise(text)
    return F.regexp_extract(unfenced, r"(?s)\[.*\]", 0)


def json_items(array: Column) -> Column:
    """The elements of a parsed array; empty for anything else."""
    return F.coalesce(
        F.try_variant_get(array, "$", "array<variant>"), F.array().cast("array<variant>")
    )


def _kind(item: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(item, path, "variant"))


def _whole_number(item: Column) -> Column:
    """Importance as a whole number, NULL where it cannot be read as one.

    Numbers are cut towards zero, booleans are 0 or 1, strings must hold a whole number.
    """
    kind = _kind(item, "$.importance")
    text = F.try_variant_get(item, "$.importance", "string")
    number = F.try_variant_get(item, "$.importance", "double")
    digits = F.regexp_extract(text, r"(?U)^\s*([+-]?\d+(?:_\d+)*)\s*\z", 1)
    return (
        F.when(kind.isNull(), F.lit(rules.DEFAULT_IMPORTANCE).cast("long"))
        .when(kind == "BIGINT", F.try_variant_get(item, "$.importance", "long"))
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0).cast("long"))
        .when(kind == "STRING", F.replace(digits, F.lit("_"), F.lit("")).try_cast("long"))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), number.cast("long"))
    )


def _subcategory(item: Column, category: Column) -> Column:
    """Subcategory, or the category's default when it is absent, null or not a plain value."""
    kind = _kind(item, "$.subcategory")
    default = F.element_at(
        F.create_map(*[F.lit(x) for pair in rules.DEFAULT_SUBCATEGORY.items() for x in pair]), category
    )
    plain = ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID")
    return F.coalesce(F.when(plain, F.try_variant_get(item, "$.subcategory", "string")), default)


def normalised_items(items: Column, category: Column) -> Column:
    """Valid items as (pos, content, importance, subcategory).

    NULL when one item is bad: then the whole output is lost, as one exception loses an
    extractor's work. Elements that are not objects, and items without text, are passed over.
    """

    def read(item: Column, pos: Column) -> Column:
        kind = _kind(item, "$.text")
        content = strip(F.try_variant_get(item, "$.text", "string"))
        importance = _whole_number(item)
        blank = kind.isNull() | ((kind == "STRING") & (content == ""))
        bad = ((kind != "STRING") | importance.isNull()) & ~blank
        return F.struct(
            pos.cast("int").alias("pos"),
            content.alias("content"),
            importance.alias("importance"),
            _subcategory(item, category).alias("subcategory"),
            (F.schema_of_variant(item).startswith("OBJECT") & ~blank).alias("keep"),
            (F.schema_of_variant(item).startswith("OBJECT") & bad).alias("bad"),
        )

    def valid(read_items: Column) -> Column:
        return F.when(
            ~F.exists(read_items, lambda r: F.coalesce(r["bad"], F.lit(False))),
            F.filter(read_items, lambda r: F.coalesce(r["keep"], F.lit(False))),
        )

    return valid(F.transform(items, read))


def memory_key(category: Column, subcategory: Column, content: Column) -> Column:
    """P10: identity of a memory; the project is not part of it."""
    return F.sha2(F.concat_ws(":", category, subcategory, content), 256)
