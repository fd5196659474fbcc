"""Hook payload columns (P12-P13, F8-F10). A payload is a VARIANT object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.text import non_empty, truncated


def _text(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "string")


def _kind(payload: Column, path: str) -> Column:
    """Type of the value at path: NULL when absent, VOID for null, OBJECT<...>, STRING, ..."""
    return F.schema_of_variant(F.try_variant_get(payload, path, "variant"))


def tool_name(payload: Column) -> Column:
    return F.coalesce(_text(payload, "$.tool_name"), F.lit(""))


# A separator of compact JSON outside strings, after what stands before it.
_SEPARATOR = r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)([,:])'


def _lowered_escapes(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda part: F.when(part.startswith("\\u"), F.lower(part)).otherwise(part)), "")


def escaped_json(text: Column) -> Column:
    """Compact JSON in which runs beyond printable ASCII are UTF-16 escapes in lower case.

    The JSON writer itself escapes some characters, in upper case.
    """
    text = F.when(text.contains("\\u"), _lowered_escapes(text)).otherwise(text)
    runs = F.split(text, r"(?<=[ -~])(?=[^ -~])|(?<=[^ -~])(?=[ -~])")

    def escaped(run: Column) -> Column:
        units = F.lower(F.hex(F.encode(run, "UTF-16BE")))
        return F.when(run.rlike("^[^ -~]"), F.regexp_replace(units, "(.{4})", r"\\u$1")).otherwise(run)

    return F.when(text.rlike("[^ -~]"), F.array_join(F.transform(runs, escaped), "")).otherwise(text)


def spaced_json(compact: Column) -> Column:
    """Compact JSON with a blank after each separator, the spelling of the usual text form."""
    return F.regexp_replace(compact, _SEPARATOR, "$1$2 ")


def text_json(compact: Column) -> Column:
    """Compact JSON in its usual text form: a blank after each separator, only ASCII."""
    # A lambda variable: the object is written once, however often its text is looked at.
    return F.transform(F.array(compact), lambda text: spaced_json(escaped_json(text)))[0]


def payload_context(payload: Column, raw: Column, max_chars: int | None = None) -> Column:
    """The largest useful text of a payload; max_chars cuts it, by default it stays whole.

    raw is the payload's JSON text. An object without text of its own appears as JSON with its
    keys in their order and a blank after each separator.
    """
    kind = _kind(payload, "$.tool_input")
    from_object = F.coalesce(
        non_empty(_text(payload, "$.tool_input.content")),
        non_empty(_text(payload, "$.tool_input.text")),
        text_json(F.get_json_object(raw, "$.tool_input")),
    )
    context = (
        F.when(kind.isNull(), F.lit("{}"))
        .when(kind.startswith("OBJECT"), from_object)
        .when(kind == "STRING", _text(payload, "$.tool_input"))
        .otherwise(text_json(F.get_json_object(raw, "$")))
    )
    result = F.when(_kind(payload, "$.tool_result") == "STRING", _text(payload, "$.tool_result"))
    whole = F.when(
        F.length(result) > rules.TOOL_RESULT_MIN_CHARS,
        F.concat(context, F.lit(rules.TOOL_RESULT_MARK), result),
    ).otherwise(context)
    return truncated(whole, max_chars)


def payload_project(payload: Column, default: str | None = None) -> Column:
    """The payload's directory, else a given project, else unknown."""
    return F.coalesce(_text(payload, "$.cwd"), F.lit(default), F.lit(rules.UNKNOWN))


def payload_session(payload: Column, given: str | None = None) -> Column:
    """A given session wins over the payload's own."""
    return F.coalesce(F.lit(given), _text(payload, "$.session_id"), F.lit(rules.UNKNOWN))


def is_compaction(payload: Column) -> Column:
    """F8."""
    return tool_name(payload).rlike(rules.COMPACTION_TOOLS)


def session_end_content(payload: Column) -> Column:
    """the first non-empty of summary, message, stop_reason and the tool input's own text."""
    tool_input = F.when(
        _kind(payload, "$.tool_input") == "STRING", _text(payload, "$.tool_input")
    ).otherwise(
        F.coalesce(
            non_empty(_text(payload, "$.tool_input.content")), _text(payload, "$.tool_input.text")
        )
    )
    return F.coalesce(
        non_empty(_text(payload, "$.summary")),
        non_empty(_text(payload, "$.message")),
        non_empty(_text(payload, "$.stop_reason")),
        tool_input,
        F.lit(""),
    )


def has_session_end_content(payload: Column, raw: Column) -> Column:
    """F9."""
    return (F.octet_length(raw) >= rules.SESSION_END_MIN_BYTES) & (
        F.length(session_end_content(payload)) > rules.SESSION_END_MIN_CHARS
    )


def is_shell(payload: Column) -> Column:
    """F10, first half."""
    return tool_name(payload).isin(rules.SHELL_TOOLS)


def shell_command(payload: Column) -> Column:
    """the command, from an object or a plain string; NULL when there is none."""
    kind = _kind(payload, "$.tool_input")
    return non_empty(
        F.when(kind.startswith("OBJECT"), _text(payload, "$.tool_input.command"))
        .when(kind.isNotNull(), _text(payload, "$.tool_input"))
    )
