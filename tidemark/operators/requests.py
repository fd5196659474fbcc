"""Requests, their attempts and their replies as ledger rows, in batch and as a stream.

Combines P1 and X1 (messages and their verdict), W1 (first success), J3-J6 (prices, named providers),
P3-P8 with Q5 and X2 (replies), and the row that S4 appends. One request is one row, however many
attempts and whichever reply it got:

- blocked: a message holds a dangerous command; provider safety_block.
- unknown_provider: it names a provider that is not configured.
- directed (it names a configured provider): only attempts at that provider count, without failover.
- otherwise the first success in chain order counts.
- success or rejected: there is a success and a reply, and the reply passes the gate or not. failed:
  anything else. Only a success counts tokens.

Attempts and replies count from the request's time on, up to a limit; the stream closes a request by the
same limits, so both forms give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.attempts import OUTCOMES
from tidemark.operators.messages import canonical_responses, flatten_messages
from tidemark.operators.pricing import priced
from tidemark.operators.safety import safety_verdicts
from tidemark.functions import chat as C
from tidemark.functions import safety as S

ATTEMPT_SECONDS = 300
REPLY_SECONDS = 600
HEARTBEAT = ""
REQUEST_COLUMNS = ["request_id", "asked_at", "safe", "role", "target_provider", "requested_model"]
LEDGER_VALUES = ["status", "provider", "model", "tokens_in", "tokens_out", "quality_score", "latency_ms"]


def _chosen(last_pos: int) -> list[Column]:
    """W1 for one request's attempts: the first success, and the last call made, of those that may count."""
    inside = F.col("chain_pos").between(0, last_pos) & (F.col("target_provider").isNull() | (F.col("provider") == F.col("target_provider")))
    call = F.struct("tried_at", "chain_pos", "latency_ms")
    return [
        F.min(F.when(inside & (F.col("status") == "success"), F.struct("chain_pos", "tried_at", "provider", "latency_ms"))).alias("_won"),
        F.max(F.when(inside & F.col("status").isin(OUTCOMES), call)).alias("_called"),
    ]


def _within(later: str, seconds: int) -> Column:
    return F.col(later).between(F.col("asked_at"), F.col("asked_at") + F.expr(f"INTERVAL {seconds} SECONDS"))


def _judged_replies(replies: DataFrame) -> DataFrame:
    return canonical_responses(replies).select(
        F.col("request_id").alias("_reply_to"), "replied_at", F.col("message.model").alias("_model"),
        F.col("tokens_in").alias("_in"), F.col("tokens_out").alias("_out"), F.col("passed").alias("_passed"), F.col("score").alias("_score"))


def _ledger_rows(rows: DataFrame, providers: DataFrame) -> DataFrame:
    """Request rows with _won, _called and the reply's columns as priced ledger rows."""
    known = providers.filter("tier = 1").groupBy(F.col("provider").alias("target_provider")).agg(F.min_by("model", "declared_pos").alias("_target_model"))
    rows = rows.join(known, "target_provider", "left")
    directed = F.col("target_provider").isNotNull()
    status = (
        F.when(~F.col("safe"), "blocked")
        .when(directed & F.col("_target_model").isNull(), "unknown_provider")
        .when(F.col("_won").isNull() | F.col("_passed").isNull(), "failed")
        .when(~F.col("_passed"), "rejected").otherwise("success")
    )
    rows = rows.withColumn("status", status)
    answered, failed, zero = F.col("status").isin("success", "rejected"), F.col("status") == "failed", F.lit(0).cast("long")
    paid = F.col("status") == "success"
    # A directed request whose provider was never called (its breaker was open) keeps the configured model.
    wanted = F.when(F.col("_called").isNull(), F.col("_target_model")).otherwise(F.coalesce("requested_model", "_target_model"))
    values = {
        "provider": F.when(F.col("status") == "blocked", "safety_block").when(answered, F.col("_won.provider")).otherwise(F.coalesce("target_provider", F.lit("none"))),
        "model": F.when(answered, F.col("_model")).when(F.col("status") == "unknown_provider", F.coalesce("requested_model", F.lit("unknown")))
        .when(failed & directed, wanted).otherwise("none"),
        "tokens_in": F.when(paid, F.col("_in")).otherwise(zero),
        "tokens_out": F.when(paid, F.col("_out")).otherwise(zero),
        "quality_score": F.when(answered, F.col("_score")).otherwise(F.lit(0.0)),
        "latency_ms": F.when(answered, F.col("_won.latency_ms")).when(failed & directed, F.coalesce("_called.latency_ms", zero)).otherwise(zero),
    }
    named = rows.select("request_id", F.col("asked_at").alias("ts"), "role", "status", *[c.alias(name) for name, c in values.items()])
    return priced(named, providers)


def request_ledger(
    requests: DataFrame, messages: DataFrame, attempts: DataFrame, replies: DataFrame, providers: DataFrame, last_pos: int,
    attempt_seconds: int = ATTEMPT_SECONDS, reply_seconds: int = REPLY_SECONDS,
) -> DataFrame:
    """One priced ledger row per request, in batch.

    requests: request_id, asked_at, role, target_provider, requested_model. messages: request_id, turn,
    role, content. attempts: request_id, chain_pos, provider, tried_at, latency_ms, status. replies:
    request_id, replied_at, response; at most one per request. All but the prices meet by request_id,
    so each table is shuffled once; a request's attempts combine map-side.
    """
    verdicts = safety_verdicts(flatten_messages(messages)).select("request_id", "safe")
    asked = requests.join(verdicts, "request_id", "left").select(
        "request_id", "asked_at", F.coalesce("safe", F.lit(True)).alias("safe"), "role", "target_provider", "requested_model")
    tried = attempts.join(requests.select("request_id", "asked_at", "target_provider"), "request_id").filter(_within("tried_at", attempt_seconds))
    tried = tried.groupBy("request_id").agg(*_chosen(last_pos))
    rows = asked.join(tried, "request_id", "left")
    rows = rows.join(_judged_replies(replies), (F.col("request_id") == F.col("_reply_to")) & _within("replied_at", reply_seconds), "left")
    return _ledger_rows(rows, providers)


def ledger_facts(
    requests: DataFrame, attempts: DataFrame, replies: DataFrame, providers: DataFrame, last_pos: int,
    lateness: str = "10 minutes", attempt_seconds: int = ATTEMPT_SECONDS, reply_seconds: int = REPLY_SECONDS,
) -> DataFrame:
    """The same rows from three streams; write in append mode.

    requests carry their messages as an array of JSON contents, so the verdict needs no state. Attempts
    join their request within its time limit and are folded to one row per request; replies join that
    row. Both joins are outer: once the watermark has passed a request's limits it is written with what it
    got. State holds open requests only, with a reply's figures but not its text. A row whose request_id
    is HEARTBEAT only moves the watermark: an idle stream needs some, or open requests wait.
    """
    contents = F.transform("messages", lambda m: C.flatten_content(C.content_variant(m)))
    safe = ~F.exists(contents, lambda text: F.size(S.dangerous_hits(text)) > 0)
    asked = requests.withWatermark("asked_at", lateness).withColumn("safe", F.coalesce(safe, F.lit(True))).select(*REQUEST_COLUMNS)
    tried = attempts.withWatermark("tried_at", lateness).select(
        F.col("request_id").alias("_tried_for"), "chain_pos", "provider", "tried_at", "latency_ms", "status")
    replied = _judged_replies(replies.withWatermark("replied_at", lateness))
    # The test names the event time, so that it stays above the watermark and heartbeats reach that.
    asked = asked.filter(F.when(F.col("asked_at").isNotNull(), F.col("request_id") != HEARTBEAT))
    joined = asked.join(
        tried, (F.col("request_id") == F.col("_tried_for")) & _within("tried_at", attempt_seconds), "leftOuter")
    folded = joined.groupBy(*REQUEST_COLUMNS).agg(*_chosen(last_pos))
    rows = folded.join(
        replied, (F.col("request_id") == F.col("_reply_to")) & _within("replied_at", reply_seconds), "leftOuter")
    return _ledger_rows(rows, providers)
