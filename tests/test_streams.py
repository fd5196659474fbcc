import json
import os

from pyspark.sql import functions as F

from tests.test_attempts import SCHEMA, fold, random_log
from tidemark.session import shared_folder, shared_path, stage, staging
from tidemark.sources.payloads import read_payload_stream
from tidemark.sources.cells import hour_cells, read_cells
from tidemark.sources.ledger import read_ledger
from tidemark.sources.sinks import read_memories
from tidemark.streaming import streams as T


def test_breaker_over_many_batches(spark):
    base = shared_path(spark, "test-breaker")
    log = random_log(11, 150, ["a", "b", "c"], 0.25)
    for part in range(3):
        spark.createDataFrame(log[part * 50:(part + 1) * 50], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/log")
        T.breaker_stream(stream, f"{base}/out", f"{base}/state", f"{base}/checkpoint").awaitTermination()
    expected, state = fold(log)
    rows = spark.read.parquet(f"{base}/out").collect()
    assert len(rows) == 150
    assert {r.request_id: (r.streak, r.open_until_s, r.made_while_open) for r in rows} == expected
    last = spark.read.parquet(f"{base}/state/batch_id=2").collect()
    assert {r.provider: (r.streak, r.open_until_s) for r in last} == state


def test_memories_from_payloads(spark):
    def extractor(category, context):
        if category == "decision":
            raise RuntimeError("model down")
        return json.dumps([{"text": f"{category} {context[:8]}", "importance": 9}])

    base = shared_path(spark, "test-memories")
    lines = [
        {"tool_name": "compact", "tool_input": {"content": "aaaaaaaa" * 20}, "cwd": "/p", "session_id": "s"},
        {"tool_name": "compact", "tool_input": {"content": "aaaaaaaa" * 30}},
        {"tool_name": "COMPACT", "tool_input": {"content": ""}},
        {"summary": "b" * 60, "tool_input": "c" * 120},
        {"tool_name": "compact", "tool_input": {"content": "short"}},
    ]
    text = "\n".join(map(json.dumps, lines)) + "\nnot json"
    spark.createDataFrame([(text,)], "value string").write.text(f"{base}/in")
    for _ in range(2):
        events = read_payload_stream(spark, f"{base}/in").withColumn("event_id", F.xxhash64("payload"))
        T.memory_stream(events, extractor, f"{base}/store", shared_path(spark, "checkpoint"), runs_path=f"{base}/runs").awaitTermination()
    got = {(r.category, r.content, r.project) for r in read_memories(spark, f"{base}/store").collect()}
    assert {(c, t) for c, t, _ in got} == {("fact", "fact aaaaaaaa"), ("skill", "skill aaaaaaaa"), ("fact", "fact cccccccc"), ("skill", "skill cccccccc")}
    assert read_memories(spark, f"{base}/store").count() == 4


def test_late_rows_are_dropped(spark):
    base = shared_path(spark, "test-windows")
    schema = "ts timestamp, provider string, model string, tokens_in long, tokens_out long, cost_usd decimal(20,8)"

    def add(*stamps):
        rows = [(t,) for t in stamps]
        df = spark.createDataFrame(rows, "t string").select(
            F.col("t").cast("timestamp").alias("ts"), F.lit("a").alias("provider"), F.lit("m").alias("model"),
            F.lit(1).cast("long").alias("tokens_in"), F.lit(1).cast("long").alias("tokens_out"), F.lit(1).cast("decimal(20,8)").alias("cost_usd"),
        )
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        T.append_stream(T.rolling_cost_windows(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()

    add("2024-01-01 00:30:00")
    add("2024-01-05 00:30:00")
    add("2024-01-01 00:40:00", "2024-01-09 00:00:00")
    early = spark.read.parquet(f"{base}/out").filter("start < '2024-01-02'")
    assert early.count() == 24
    assert early.agg(F.max("requests")).first()[0] == 1


def staged(spark, label):
    folder = os.path.join(shared_folder(spark).removeprefix("file:"), "tidemark")
    return {name for name in os.listdir(folder) if name.startswith(label)}


def test_staged_tables_go_with_their_scope(spark):
    with staging(spark):
        assert stage(spark.range(3), "scoped").count() == 3
        with staging(spark):
            stage(spark.range(3), "scoped")
            assert len(staged(spark, "scoped")) == 2
        assert len(staged(spark, "scoped")) == 1
    assert not staged(spark, "scoped")


def test_breaker_batches_leave_nothing_staged(spark):
    base, before = shared_path(spark, "test-breaker"), staged(spark, "ranges")
    schema = "provider string, request_id long, chain_pos int, ts_s long, latency_ms long, status string, error string"
    for batch in range(2):
        spark.createDataFrame([("a", 10 * batch + i, 1, 100 * batch + i, 1, "failed", "e") for i in range(4)], schema).write.mode("append").parquet(f"{base}/in")
        T.breaker_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", f"{base}/checkpoint").awaitTermination()
    assert sorted(r.streak for r in spark.read.parquet(f"{base}/out").collect()) == list(range(1, 9))
    assert staged(spark, "ranges") == before


def test_ledger_stream_keeps_cells_current(spark):
    base = shared_path(spark, "test-ledger-stream")
    schema = ("request_id string, ts timestamp, provider string, model string, tokens_in long, tokens_out long, cost_usd decimal(20,8), "
              "quality_score double, latency_ms long, status string, role string")
    for part in range(3):
        spark.range(part * 50, part * 50 + 50).select(
            F.col("id").cast("string").alias("request_id"),
            F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % 40) * 7200).alias("ts"), F.lit("a").alias("provider"), F.lit("m").alias("model"),
            F.col("id").alias("tokens_in"), F.col("id").alias("tokens_out"), F.lit("0.5").cast("decimal(20,8)").alias("cost_usd"),
            F.lit(0.5).alias("quality_score"), F.col("id").alias("latency_ms"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("role"),
        ).write.mode("append").parquet(f"{base}/in")
        facts = spark.readStream.schema(schema).parquet(f"{base}/in")
        T.ledger_stream(facts, f"{base}/rows", f"{base}/checkpoint", f"{base}/cells").awaitTermination()
    rows, cells = read_ledger(spark, f"{base}/rows"), read_cells(spark, f"{base}/cells")
    expected = hour_cells(rows)
    assert rows.count() == 150 and cells.agg(F.sum("requests")).first()[0] == 150
    assert sorted(map(str, cells.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
