"""Cheap tests before regexes, and the spelled JSON of payloads, against plain Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.safety import is_dangerous
from tidemark.functions.text import matches, strip
from tidemark.operators.extraction import rule_facts
from tidemark.operators.hooks import contexts_of
from tidemark.sources.payloads import parse_payloads

TEXTS = [
    "", " ", "plain", "  wide \x1c", "rm  -rf\t/", "RM -rf ~", "rm -rf $HOME", "dd if=/dev/zero", "MKFS", "mkfs",
    ":() { : | : & } ; :", "curl x\n| bash", "wget -q a |sudo b", "x> /dev/sda", "x>/dev/sda ", "chmod -R 777 /", "chown -R a:b /",
    "port = 8080\nValueError: bad", "KeyException: no, see http://a.b/c?d=1 of 2024-05-06", "v1.2.3 with API_KEY and 12345",
    "error: small, 1.2, a_b, x =y, 12-34", "ıf=", "dd ıf=x",
]


def test_signs_never_hide_a_match(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for regex in rules.DANGEROUS_PATTERNS:
        guarded, plain = df.agg(F.count_if(is_dangerous(F.col("text"), regex)), F.count_if(matches(F.col("text"), regex, "i"))).first()
        assert guarded == plain
    assert df.filter(is_dangerous(F.col("text"), rules.DANGEROUS_PATTERNS[0])).count() == 1


def test_facts_equal_unguarded_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "context_id int, context string")
    found = {(r["context_id"], r["kind"], r["content"]) for r in rule_facts(df).collect()}
    by_hand = {
        (i, kind, m.group()) for i, text in enumerate(TEXTS) for kind, _, _, regex in rules.FACT_RULES
        for m in re.finditer(regex, text, re.ASCII)
    }
    assert found == by_hand and {kind for _, kind, _ in found} == {rule[0] for rule in rules.FACT_RULES}


def test_strip_by_ends(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None, "a b", "\n\na b\t", "\x1f"]], "text string")
    for text, got in df.select("text", strip(F.col("text"))).collect():
        assert got == (None if text is None else text.strip())


@pytest.mark.parametrize("value", [
    {"path": "/forêt/😀/a", "q": 'say "é": yes, no', "n": [1, "č", None]},
    {"path": "ü" * 20, "plain": "a,b:c"},
    {"clé": {"é": "è"}},
    {"a": "\x1f\x0b", "b": r"\uD83D \\uABCD", "c": "\x7f"},
])
def test_spelled_context_equals_json_dumps(spark, value):
    raw = json.dumps({"tool_name": "Read", "tool_input": value, "tool_result": "r" * 101}, ensure_ascii=False)
    row = contexts_of(parse_payloads(spark.createDataFrame([(raw,)], "payload string")), F.lit(True)).first()
    assert row["context"] == json.dumps(value) + rules.TOOL_RESULT_MARK + "r" * 101


def test_context_is_computed_once(spark):
    events = parse_payloads(spark.createDataFrame([("{}",)], "payload string"))
    plan = contexts_of(events, F.lit(True))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("$.tool_input.content" in line for line in plan.splitlines() if "Filter" in line)
