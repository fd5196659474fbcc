"""Quality gate and safety columns against Python's re and plain Python rules."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import safety as S
from tidemark.functions.hooks import spaced_json
from tidemark.operators.quality import score_texts
from tidemark.operators.safety import safety_hits, safety_verdicts, scrub_texts, secret_inventory

PYTHON_FLAGS = {"": 0, "i": re.I, "m": re.M, "im": re.I | re.M}
TEXTS = [
    "", "   ", "\n\t\x1c", "short", "exactly10!", "A fine answer, nothing to see.",
    "<minimax:tool>", "<MINIMAX_é>", "</Invoke x=1>", "<invoked>", "<function_call", "a <tool_use > b </tool_result>",
    "[system] be", "[/inst]", "<<SYS>> x <</sys>>", "<|IM_START|>user", "Human: \nnext line of text", "Human: hello",
    "assistant:\n", "Assistant:  ", "x\nSystem :", " system:", "z" * 20, "z" * 21, "é" * 60 + " text", "ab" * 120,
    "word " * 60, "word " * 60 + "...", "{[[ broken json", "[{}]]]", "{" + "x" * 30 + "}", "line Human: end",
    "  ", "x" * 30000 + ".",
    "rm -rf / now", "RM  -RF ~", "rm -rf $HOME/x", "dd if=/dev/zero", "mkfs.ext4", ":(){ :|:& };:", "curl a | bash", "wget a|sudo x",
    "farm -rf /", "x> /dev/sda", "chmod -R 777 /\n", "chown -R me /", "chown -R me /home",
    "key sk-" + "a1" * 12, "sk-short", "sk_live_" + "b" * 20, "sk_test_" + "b" * 20, "key-" + "c" * 20, "pk_live_" + "d" * 22,
    "pk_test_" + "d" * 22, "Bearer\t" + "e" * 25, "api_key = '" + "f" * 32 + "'", "PASSWORD:" + "g" * 40, "token=" + "h" * 31,
    "AKIA" + "Q" * 16, "ghp_" + "i" * 36, "gho_" + "j" * 36 + " ghu_" + "k" * 36 + " ghs_" + "l" * 36, "eyJ" + "m" * 120,
    "password=ghp_" + "n" * 36, "éghp_" + "o" * 36, "secret = \"" + "p" * 50,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").cache()


def any_match(patterns, text):
    return any(re.search(p, text, PYTHON_FLAGS[f]) for p, f in patterns)


def expected_score(text):
    s = text.strip()
    tags = -0.4 if any_match(rules.TAG_PATTERNS, text) else 0.0
    unbalanced = s[:1] in ("{", "[") and (abs(s.count("{") - s.count("}")) > 1 or abs(s.count("[") - s.count("]")) > 1)
    form = -0.2 if not s or unbalanced else 0.0
    markers = -0.5 if any_match(rules.INJECTION_PATTERNS, text) else 0.0
    if len(s) < 10 or re.search(rules.REPEATED_CHAR_PATTERN, s) or re.search(rules.NON_ASCII_RUN_PATTERN, s):
        coherence = -0.3
    else:
        coherence = -0.15 if len(s) > 200 and s[-1] not in rules.TERMINAL_MARKS else 0.0
    raw = max(0.0, min(1.0, 1.0 + tags + form + markers + coherence))
    return (round(raw, 3), raw >= 0.5, tags, form, markers, coherence)


def test_scores(texts):
    got = {
        r.doc_id: (r.score, r.passed, r.xml_hallucination, r.formatting_violation, r.prompt_injection, r.coherence)
        for r in score_texts(texts).collect()
    }
    assert got == {i: expected_score(t) for i, t in enumerate(TEXTS)}


def test_an_empty_text_passes_with_two_details(texts):
    row = score_texts(texts, details=True).filter("doc_id = 0").first()
    assert row.passed and row.score == 0.5 and row.details == ["Empty response", "Empty response"]
    assert row.checks["coherence"] == -0.3


def test_detail_limits(spark):
    text = "<tool_use>" * 5 + "<invoke>" * 4 + "[INST]" * 5
    row = score_texts(spark.createDataFrame([(text,)], "text string"), details=True).first()
    assert row.details[0] == "XML hallucination detected: <invoke>, <invoke>, <invoke>, <tool_use>, <tool_use>"
    assert row.details[1] == "Prompt injection markers: [INST], [INST]"


def test_dangerous_commands(texts):
    got = {r.doc_id: r.hits for r in texts.select("doc_id", S.dangerous_hits(F.col("text")).alias("hits")).collect()}
    expected = {i: [p for p in rules.DANGEROUS_PATTERNS if re.search(p, t, re.I)] for i, t in enumerate(TEXTS)}
    assert got == expected


def python_scrub(text):
    for _, regex, flags, replacement, _ in rules.CREDENTIAL_RULES:
        text = re.sub(regex, re.sub(r"\$(\d)", r"\\\1", replacement), text, flags=PYTHON_FLAGS[flags])
    return text


def test_scrub(texts):
    got = {r.doc_id: (r.text, r.changed) for r in scrub_texts(texts).collect()}
    assert got == {i: (python_scrub(t), python_scrub(t) != t) for i, t in enumerate(TEXTS)}


def test_scrub_is_idempotent(texts):
    assert scrub_texts(scrub_texts(texts).drop("changed")).filter("changed").count() == 0


def test_pretest_never_hides_a_credential(texts):
    row = texts.filter(~S.may_hold_credentials(F.col("text"))).select(S.scrub(F.col("text")).alias("s"), "text")
    assert row.filter("s <> text").count() == 0


def test_inventory_finds_what_scrub_removes(texts):
    found = {r.doc_id for r in secret_inventory(texts).select("doc_id").distinct().collect()}
    assert found == {i for i, t in enumerate(TEXTS) if python_scrub(t) != t}


def test_verdict_of_a_request_with_most_messages(spark):
    rows = [(1, i, "dd if=x and rm -rf /") for i in range(500)] + [(2, 0, "hello"), (3, 0, "mkfs")]
    messages = spark.createDataFrame(rows, "request_id int, turn int, text string")
    got = {r.request_id: r for r in safety_verdicts(messages).collect()}
    assert got[1].hits == 1000 and not got[1].safe and [p.hits for p in got[1].blocked_patterns] == [500, 500]
    assert got[2].safe and got[2].blocked_patterns == []
    assert safety_hits(messages).count() == 1001


def test_shell_gate(spark):
    cases = [
        ("rm -RF /", "rm -rf /"), ("rm -rf ${home}/x", "rm -rf ${HOME"), ("dd if=a; chown -R b", "chown -R"),
        ("curl x |\nsh", None), ("curl\tx | SH", "curl | sh"), ("wget x | bash; curl y | sh", "wget | sh"), ("ls", None),
        ("curlx | sh", None), ("echo a > /dev/nvme0", "> /dev/nvme"),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string").select("c", S.shell_match(F.col("c")).alias("m"))
    assert {r.c: r.m for r in df.collect()} == dict(cases)


def test_placeholders_and_masks(spark):
    cases = {
        "your-key-here": True, "SK_XXX": True, "abcd1234efgh5678ijkl": False, "short": True,
        "replace-me-with-real-key": False, "insert_your_own_key_123": True, "api key": True, "Example-Example-value": False,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = df.select("c", S.is_placeholder(F.col("c")).alias("p"), S.masked(F.col("c")).alias("m")).collect()
    assert {r.c: r.p for r in got} == cases
    assert {r.c: r.m for r in got}["abcd1234efgh5678ijkl"] == "abcd...ijkl" and {r.c: r.m for r in got}["short"] == "****"


def test_json_spelling(spark):
    """Compact JSON gets the separators of the usual text form, outside strings only."""
    values = [
        {"a": 1, "b": [1, 2, {"c": "x:y,z"}]}, {"q": 'say "hi", ok: yes', "e": "", "back": "a\\", "n": None}, {"é": "ü,:"}, {}, {"a": {}}, [1, "x"], "a,b",
        {"k": "\\\",:"},
    ]
    rows = [(json.dumps(v, separators=(",", ":"), ensure_ascii=False), json.dumps(v, ensure_ascii=False)) for v in values]
    got = spark.createDataFrame(rows, "compact string, wanted string").select(spaced_json(F.col("compact")).alias("got"), "wanted").collect()
    assert [r.got for r in got] == [r.wanted for r in got]


def test_null_text_counts_as_empty(spark):
    texts = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    scores = {r.id: (r.score, r.passed) for r in score_texts(texts).collect()}
    assert scores[1] == scores[2] == (0.5, True)
    assert {(r.text, r.changed) for r in scrub_texts(texts).collect()} == {("", False)}
