import random

import pytest

from tidemark.operators import attempts as A

SCHEMA = "provider string, request_id long, chain_pos int, ts_s long, latency_ms long, status string, error string"


def random_log(seed, rows, providers, ok):
    rng = random.Random(seed)
    out, ts = [], 0
    for i in range(rows):
        ts += rng.choice([0, 1, 5, 40, 90])
        # the first provider holds a third of all rows and more
        provider = providers[0] if rng.random() < 0.4 else rng.choice(providers)
        status = "success" if rng.random() < ok else rng.choice(["failed", "rejected"])
        out.append((provider, i, 1, ts, i % 100, status, None if status == "success" else "e"))
    return out


def fold(rows):
    state, out = {}, {}
    for provider, request, pos, ts, _, status, _ in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        streak, until = state.get(provider, (0, None))
        after = 0 if status == "success" else streak + 1
        out[request] = (after, until, until is not None and ts < until)
        state[provider] = (after, ts + 60 if after >= 3 else until)
    return out, state


@pytest.fixture(params=["one", "many"])
def ranges(spark, request):
    """Few rows are one range by default; without coalescing they are cut into many."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    if request.param == "many":
        spark.conf.set(key, "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield request.param
    spark.conf.set(key, old[0])
    spark.conf.set("spark.sql.shuffle.partitions", old[1])


@pytest.mark.parametrize("seed,rows,providers,ok", [
    (1, 300, ["a", "b", "c"], 0.3), (2, 200, ["a"], 0.02), (3, 60, ["a", "b"], 0.0), (4, 40, list("abcdefghij"), 0.5),
])
def test_streaks_equal_a_fold(spark, ranges, seed, rows, providers, ok):
    log = random_log(seed, rows, providers, ok)
    expected, _ = fold(log)
    got = A.failure_streaks(spark.createDataFrame(log, SCHEMA)).collect()
    assert {r.request_id: (r.streak, r.open_until_s, r.made_while_open) for r in got} == expected
    assert len(got) == rows


def test_state_continues_a_log(spark, ranges):
    log = random_log(7, 200, ["a", "b"], 0.2)
    expected, state = fold(log)
    first = A.failure_streaks(spark.createDataFrame(log[:120], SCHEMA))
    second = A.failure_streaks(spark.createDataFrame(log[120:], SCHEMA), state=A.breaker_state(first))
    got = {r.request_id: (r.streak, r.open_until_s, r.made_while_open) for r in second.collect()}
    assert got == {k: v for k, v in expected.items() if k >= 120}
    end = {r.provider: (r.streak, r.open_until_s) for r in A.breaker_state(second).collect()}
    assert end == state


def test_outcomes(spark):
    rows = [
        ("x", 1, 0, 0, 5, "failed", "HTTP 500"), ("a", 1, 1, 1, 5, "rejected", "Quality gate"), ("b", 1, 2, 2, 7, "success", None),
        ("x", 2, 0, 0, 5, "failed", "HTTP 500"), ("a", 2, 1, 1, 5, "failed", "circuit breaker open"), ("b", 2, 2, 1, 5, "failed", "t/o"),
        ("x", 3, 0, 0, 9, "success", None),
    ]
    got = {r.request_id: r for r in A.request_outcomes(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert (got[1].provider, got[1].status, got[1].chain_pos, got[1].error) == ("b", "success", 2, None)
    assert (got[2].provider, got[2].status, got[2].error) == ("none", "failed", "a: circuit breaker open; b: t/o")
    assert (got[3].provider, got[3].chain_pos, got[3].latency_ms) == ("x", 0, 9)
    strays = {r.request_id: r for r in A.request_outcomes(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert (strays[1].status, strays[1].error, strays[1].stray_attempts) == ("failed", "a: Quality gate", 1)
    assert (got[1].stray_attempts, strays[3].stray_attempts) == (0, 0)


def test_no_error_is_lost(spark):
    rows = [
        ("a", 1, 1, 0, 5, "failed", "x"), ("a", 1, 1, 1, 5, "failed", "y"), ("a", 1, 1, 2, 5, "failed", "y"), (None, 1, 2, 3, 5, None, None),
        ("b", 1, 2, 4, 5, "skipped", "circuit breaker open"),
    ]
    row = A.request_outcomes(spark.createDataFrame(rows, SCHEMA), 2).first()
    assert row.error == "a: x; a: y x2; None: None; b: circuit breaker open"


def test_only_outcomes_count(spark):
    rows = [("a", i, 1, i, 1, status, None) for i, status in enumerate(["failed", "skipped", None, "state", "failed", "blocked", "rejected"])]
    rows.append((None, 9, 1, 9, 1, "failed", None))
    got = {r.request_id: r.streak for r in A.failure_streaks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 1, 4: 2, 6: 3}
    configured = spark.createDataFrame([("a",), ("new",)], "provider string")
    health = {r.provider: r for r in A.provider_health(spark.createDataFrame(rows, SCHEMA), 30, providers=configured).collect()}
    assert (health["a"].total_requests, health["a"].circuit_open) == (3, True)
    assert (health["new"].total_requests, health["new"].available, health["new"].circuit_open) == (0, True, False)


def test_health_without_success(spark):
    log = [("a", i, 1, i, 1, "failed", "e") for i in range(3)]
    row = A.provider_health(spark.createDataFrame(log, SCHEMA), 30).first()
    assert (row.avg_latency_ms, row.consecutive_failures, row.available) == (0.0, 3, False)
    assert A.provider_health(spark.createDataFrame(log, SCHEMA), 62).first().available


def test_streak_plan_has_no_provider_window(spark):
    plan = A.failure_streaks(spark.createDataFrame(random_log(1, 10, ["a"], 0.5), SCHEMA))._jdf.queryExecution().toString()
    assert "windowspecdefinition(provider" not in plan
