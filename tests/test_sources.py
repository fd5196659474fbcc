import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.text import base_name, snippet, strip
from tidemark.operators import ledger as L
from tidemark.operators import pricing as P
from tidemark.session import shared_path
from tidemark.sources.ledger import append_ledger, read_ledger
from tidemark.sources.cells import append_with_cells, read_cells, rolling_cells
from tidemark.sources.payloads import parse_payloads, quarantined, read_contexts, readable
from tidemark.sources.providers import default_providers, providers_from_config, starter_providers
from tidemark.sources.sinks import append_audit


def test_ledger_round_trip_and_older_files(spark):
    path = shared_path(spark, "test-ledger")
    old = spark.createDataFrame(
        [("i1", dt.datetime(2024, 1, 1), "a", "m", 10, 5, 0.5, 1, "success", dt.date(2024, 1, 1))],
        "id string, ts timestamp, provider string, model string, tokens_in long, tokens_out long, quality_score double, latency_ms long, status string, date date",
    ).withColumn("cost_usd", F.lit("0.00000100").cast("decimal(20,8)"))
    old.write.partitionBy("date").parquet(path)
    new = spark.createDataFrame(
        [("a", "m", 100, 50, 0.9, 12, "success", "coder")],
        "provider string, model string, tokens_in long, tokens_out long, quality_score double, latency_ms long, status string, role string",
    ).withColumn("cost_usd", F.lit("0.00000200").cast("decimal(20,8)"))
    append_ledger(new, path)
    rows = {r.role: r for r in read_ledger(spark, path).collect()}
    assert rows[None].id == "i1" and len(rows["coder"].id) == 36
    recent = L.rolling_window(read_ledger(spark, path))
    assert recent.count() == 1
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThan(ts" in plan


def test_cutoff_is_strict(spark):
    now = dt.datetime(2024, 1, 2)
    rows = [(now - dt.timedelta(hours=24),), (now - dt.timedelta(hours=24) + dt.timedelta(seconds=1),)]
    assert L.rolling_window(spark.createDataFrame(rows, "ts timestamp_ntz"), now).count() == 1


def test_empty_ledger_gives_zeros(spark):
    empty = spark.createDataFrame([], "tokens_in long, tokens_out long, cost_usd decimal(20,8), status string")
    assert tuple(L.lifetime_savings(empty).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    assert tuple(L.rolling_totals(empty).first()) == (0.0, 0.0, 0.0, 0.0)


def test_baseline_is_a_parameter(spark):
    row = spark.createDataFrame([(1_000_000, 0, 1)], "tokens_in long, tokens_out long, c int").withColumn("cost_usd", F.col("c").cast("decimal(20,8)"))
    assert tuple(L.rolling_totals(row, price_in="4", price_out="0").first()) == (1.0, 4.0, 3.0, 75.0)


def test_provider_tables(spark):
    config = {
        "providers": {"a": {"model": "m1", "cost_per_million": {"input": 2, "output": 4}}, "ollama": {"model": "m2"}, "b": {"model": "m1", "cost_per_million": {"input": 1}}},
        "failover_chain": ["b", "a"], "extra_providers": {"a": {"cost_per_million": {"input": 9}}, "x": {"cost_per_million": {"output": 7}}},
    }
    table = providers_from_config(spark, config)
    prices = {r.provider: (float(r.price_in), float(r.price_out)) for r in P.price_table(table).collect()}
    assert prices == {"a": (2.0, 4.0), "b": (1.0, 0.0), "ollama": (0.0, 0.0), "x": (0.0, 7.0)}
    chain = {r.chain_pos: r.provider for r in P.default_chain(table.filter("tier = 1")).collect()}
    assert chain == {1: "b", 2: "a", 3: "ollama"}
    ask = spark.createDataFrame([("m1",), ("zz",), (None,)], "requested_model string")
    assert {r.requested_model: r.model_provider for r in P.provider_for_model(ask, table).collect()} == {"m1": "a", "zz": None, None: None}
    assert default_providers(spark).count() == 10 and starter_providers(spark).count() == 12


def test_text_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff end\nsecond")
    assert read_contexts(spark, str(tmp_path)).first().context == "ok � end\nsecond"


def test_payload_parsing(spark):
    lines = ['{"a":1}', '  {"a":1} ', '{"a":1} x', '{"a":1}{"b":2}', "[1]", "3", "", '{"a":', '{"a":1,"a":2}', '{"a":1}],[2']
    events = parse_payloads(spark.createDataFrame([(x,) for x in lines], "payload string"))
    assert {r.payload for r in readable(events).collect()} == {lines[0], lines[1], lines[8]}
    assert quarantined(events).count() == len(lines) - 3


def test_audit_sink(spark):
    path = shared_path(spark, "test-audit")
    append_audit(spark.createDataFrame([("safety", "BLOCKED")], "tag string, text string"), path)
    assert spark.read.parquet(path).filter("ts is not null and tag = 'safety'").count() == 1


def test_text_helpers(spark):
    df = spark.createDataFrame([(" \x1c a b\n\t", "/home/u/p1/"), ("x" * 121, "p")], "t string, p string")
    rows = df.select(strip(F.col("t")).alias("s"), snippet(F.col("t")).alias("n"), base_name(F.col("p")).alias("b")).collect()
    assert (rows[0].s, rows[0].b) == ("a b", "p1")
    assert rows[1].n == "x" * 117 + "..." and rows[1].b == "p"


def test_prices_are_broadcast_by_their_size(spark):
    log = spark.range(10).select(
        F.concat(F.lit("p"), F.col("id")).alias("provider"), F.col("id").alias("tokens_in"), F.col("id").alias("tokens_out")
    )
    plan = P.priced(log, default_providers(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_cells_give_the_figures_of_the_rows(spark):
    path = shared_path(spark, "test-cells")
    start = dt.datetime(2024, 1, 1)
    rows = [
        (f"i{i}", start + dt.timedelta(minutes=20 * i), "ab"[i % 2], "m", i, 2 * i, 0.25 * (i % 4), i,
         ("success", "failed", "rejected")[i % 3], (None, "coder")[i % 2])
        for i in range(300)
    ]
    records = spark.createDataFrame(
        rows, "id string, ts timestamp, provider string, model string, tokens_in long, tokens_out long, quality_score double, "
        "latency_ms long, status string, role string").withColumn("cost_usd", F.col("tokens_in").cast("decimal(20,8)") / 1000)
    append_with_cells(records.where("id <> 'i3'"), f"{path}/rows", f"{path}/cells")
    files = {r[0] for r in read_cells(spark, f"{path}/cells").select(F.input_file_name()).distinct().collect()}
    append_with_cells(records.where("id = 'i3'"), f"{path}/rows", f"{path}/cells")
    ledger, cells = read_ledger(spark, f"{path}/rows"), read_cells(spark, f"{path}/cells")
    after = {r[0] for r in cells.select(F.input_file_name()).distinct().collect()}
    assert files ^ after and all("date=2024-01-01" in f for f in files ^ after)
    assert cells.agg(F.sum("requests")).first()[0] == 300
    for report in (L.lifetime_savings, L.rolling_costs, L.cost_report, L.rolling_totals):
        assert sorted(map(str, report(cells).collect())) == sorted(map(str, report(ledger).collect()))
    # Cutoffs on an hour, on a row and between rows; a window of no rows; one of all.
    for minutes in (24 * 60, 24 * 60 + 20, 2 * 24 * 60 + 7, 10**5, 60):
        as_of = start + dt.timedelta(minutes=minutes)
        for report in (L.rolling_costs, L.rolling_costs_by_role, L.rolling_totals):
            expected = report(L.rolling_window(ledger, as_of)).collect()
            assert report(rolling_cells(cells, ledger, as_of)).collect() == expected
    plan = rolling_cells(cells, ledger, as_of)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(date") == 2


def test_cells_of_an_empty_ledger(spark):
    path = shared_path(spark, "test-cells")
    records = spark.createDataFrame(
        [], "provider string, model string, tokens_in long, tokens_out long, quality_score double, latency_ms long, status string, cost_usd decimal(20,8)")
    append_with_cells(records, f"{path}/rows", f"{path}/cells")
    assert L.lifetime_savings(read_cells(spark, f"{path}/cells")).first().total_requests == 0
