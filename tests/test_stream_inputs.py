"""Event payloads are read once per row, and a batch's rows stand in enough files."""

import os

from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.session import shared_path
from tidemark.sources.payloads import parse_payloads
from tidemark.streaming import streams as T


def test_filters_do_not_repeat_the_reading_of_a_payload(spark):
    texts = ['{"tool_name":"Bash","tool_input":{"command":"rm -rf /"}}', '{"tool_name":"Bash","tool_input":"ls"}', ' {"tool_name":"Read"}', '[1]', '7', 'no', '{"a":1} x', None]
    events = spark.createDataFrame(list(enumerate(texts)), "event_id int, payload string")
    parsed = parse_payloads(events)
    assert [r.event_id for r in parsed.filter("event is not null").orderBy("event_id").collect()] == [0, 1, 2]
    alerts = T.command_alerts(parsed)
    assert [(r.event_id, r.command) for r in alerts.collect()] == [(0, "rm -rf /")]
    assert alerts._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get") < 12


def test_arriving_rows_stand_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(catalog, "ARRIVING_ROWS", 100)
    path, out = shared_path(spark, "arriving"), shared_path(spark, "arrived")
    catalog.arriving(spark.range(0, 1500, 1, 1), "id", path, lambda rows: T.append_stream(rows, f"{out}/data", f"{out}/checkpoint"))
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) >= 15
    assert spark.read.parquet(f"{out}/data").agg(F.count(F.lit(1)), F.sum("id")).first() == (1500, 1499 * 750)
