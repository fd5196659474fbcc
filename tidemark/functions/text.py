"""Text helpers shared by all column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(regex: str, flags: str = "") -> str:
    """A pattern with Unicode classes, where only a newline ends a line.

    flags: i = any case (Unicode rules), m = anchors at every line.
    """
    return "(?dU" + ("iu" if "i" in flags else "") + ("m" if "m" in flags else "") + ")" + regex


def matches(text: Column, regex: str, flags: str = "") -> Column:
    return text.rlike(pattern(regex, flags))


def strip(text: Column) -> Column:
    """Cut all Unicode white space at both ends (trim cuts spaces only).

    The replacement looks at every blank inside, so it runs only where an end is white space.
    """
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(
        ends.rlike(r"(?U)[\s\x1c-\x1f]"), F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    ).otherwise(text)


def ascii_lower(text: Column) -> Column:
    """Lower A-Z only, as SQL LIKE without case does."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def non_empty(text: Column) -> Column:
    """NULL for an empty string, so that coalesce falls through to the next choice."""
    return F.nullif(text, F.lit(""))


def snippet(text: Column, width: int = 120) -> Column:
    """Trimmed text, cut to width with dots at the end."""
    text = strip(text)
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    ).otherwise(text)


def truncated(text: Column, chars: int | None) -> Column:
    """First chars characters (P11, error text of P15); the whole text for None."""
    return text if chars is None else F.substring(text, 1, chars)


def base_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


# Ends the wrapped text below; a text that holds it itself is not valid input.
_JSON_END = "\u0001end of text\u0001"


def with_json(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add out: the JSON value of text as VARIANT, NULL for bad JSON.

    The parser stops after the first value and ignores what follows, so the text is parsed as the
    first of two array elements: anything after its value breaks the array. Parse and value sit in
    generators because the optimiser would copy a plain expression into every filter on it.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(f',"{_JSON_END}"]'.replace("\u0001", "\\u0001")))
    parsed = df.select("*", F.explode(F.array(F.try_parse_json(wrapped))).alias("_json"))
    whole = F.try_variant_get("_json", "$[1]", "string") == _JSON_END
    value = F.when(whole, F.try_variant_get("_json", "$[0]", "variant"))
    return parsed.select(*[c for c in df.columns if c != out], F.explode(F.array(value)).alias(out))
