"""Request rows by their cause: blocked, unknown, directed, answered, late and missing replies."""

from pyspark.sql import functions as F

from tidemark.operators import requests as N
from tidemark.sources.providers import default_providers

REPLY = '{"id":"r","model":"m1","choices":[{"message":{"content":"A good long answer to the question."}}],"usage":{"prompt_tokens":10,"completion_tokens":7}}'


def test_each_cause_has_its_row(spark):
    def table(rows, schema, seconds, name):
        return spark.createDataFrame(rows, schema).withColumn(name, F.timestamp_seconds(F.col(seconds)))

    asked = [(r, 1000, None, t, m) for r, t, m in (
        ("ok", None, None), ("bad", None, None), ("unknown", "nowhere", None), ("directed", "xai", "own"), ("skipped", "xai", "own"),
        ("silent", None, None), ("late", None, None), ("untried", None, None))]
    requests = table(asked, "request_id string, s long, role string, target_provider string, requested_model string", "s", "asked_at")
    messages = spark.createDataFrame([(r, 0, "user", '"rm -rf /"' if r == "bad" else '"hi"') for r, *_ in asked], "request_id string, turn int, role string, content string")
    tried = [("ok", 1, "deepseek", 1001, 5, "failed"), ("ok", 2, "xai", 1002, 7, "success"), ("directed", 1, "deepseek", 1001, 5, "success"), ("directed", 2, "xai", 1003, 9, "failed"),
             ("skipped", 2, "xai", 1001, 0, "skipped"), ("silent", 1, "deepseek", 1001, 5, "success"), ("late", 1, "deepseek", 1001, 5, "success"), ("untried", 1, "deepseek", 999, 5, "success")]
    attempts = table(tried, "request_id string, chain_pos int, provider string, s long, latency_ms long, status string", "s", "tried_at")
    replies = table([(r, s, REPLY) for r, s in (("ok", 1600), ("bad", 1001), ("late", 1601), ("untried", 1001))], "request_id string, s long, response string", "s", "replied_at")
    rows = N.request_ledger(requests, messages, attempts, replies, default_providers(spark), 6).collect()
    got = {r.request_id: (r.status, r.provider, r.model, r.tokens_in, r.latency_ms) for r in rows}
    configured = got["skipped"][2]
    assert len(rows) == len(asked) and configured not in ("own", "none")
    assert got == {
        "ok": ("success", "xai", "m1", 10, 7), "bad": ("blocked", "safety_block", "none", 0, 0), "unknown": ("unknown_provider", "nowhere", "unknown", 0, 0),
        "directed": ("failed", "xai", "own", 0, 9), "skipped": ("failed", "xai", configured, 0, 0), "silent": ("failed", "none", "none", 0, 0),
        "late": ("failed", "none", "none", 0, 0), "untried": ("failed", "none", "none", 0, 0),
    }
