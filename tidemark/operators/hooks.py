"""Hook event operators (F5, F8-F10, P12-P13, S9). All are row-wise, for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import hooks as H
from tidemark.operators.safety import shell_gate
from tidemark.sources.payloads import readable


def _keys(events: DataFrame, raw: str) -> list[str]:
    return [c for c in events.columns if c not in (raw, "event")]


def contexts_of(
    events: DataFrame, keep: Column, raw: str = "payload",
    project: str | None = None, session_id: str | None = None, max_chars: int | None = None,
) -> DataFrame:
    """P12, P13 and F5 over the events that keep selects; max_chars (optional) is P11.

    The context sits in a generator because the length filter would otherwise compute it again.
    """
    context = H.payload_context(F.col("event"), F.col(raw), max_chars)
    return (
        readable(events)
        .filter(keep)
        .select(
            *_keys(events, raw),
            F.explode_outer(F.array(context)).alias("context"),
            H.payload_project(F.col("event"), project).alias("project"),
            H.payload_session(F.col("event"), session_id).alias("session_id"),
        )
        .filter(F.length("context") >= rules.MIN_CONTEXT_CHARS)
    )


def compaction_events(events: DataFrame, raw: str = "payload") -> DataFrame:
    """F8: compaction events with their context length in bytes for the audit log."""
    return readable(events).filter(H.is_compaction(F.col("event"))).select(
        *_keys(events, raw),
        H.tool_name(F.col("event")).alias("tool_name"),
        F.octet_length(F.col(raw)).alias("payload_bytes"),
    )


def session_end_events(events: DataFrame, raw: str = "payload") -> DataFrame:
    """events with enough content left, and that content."""
    return readable(events).filter(H.has_session_end_content(F.col("event"), F.col(raw))).select(
        *_keys(events, raw),
        H.session_end_content(F.col("event")).alias("content"),
        F.octet_length(F.col(raw)).alias("payload_bytes"),
    )


def shell_commands(events: DataFrame, raw: str = "payload") -> DataFrame:
    """Shell commands with the gate's verdict. The command sits in a generator, as in contexts_of."""
    commands = (
        readable(events)
        .filter(H.is_shell(F.col("event")))
        .select(*_keys(events, raw), F.explode_outer(F.array(H.shell_command(F.col("event")))).alias("command"))
        .filter(F.col("command").isNotNull())
    )
    return shell_gate(commands)


def dispatch_audit(selected: DataFrame, tag: str) -> DataFrame:
    """One log row per dispatched event, with the tool's name where the event has one."""
    tool = F.concat(F.lit("tool="), F.col("tool_name"), F.lit(" ")) if "tool_name" in selected.columns else F.lit("")
    return selected.select(
        *[c for c in selected.columns if c not in ("payload_bytes", "content")],
        F.lit(tag).alias("tag"),
        F.concat(
            F.lit("Dispatched ("), tool, F.lit("payload_bytes="), F.col("payload_bytes").cast("string"), F.lit(")")
        ).alias("text"),
    )
