"""Check SQL for the catalog: the same results in plain SQL, over the same input views."""

from __future__ import annotations

import re

from tidemark import rules
from tidemark.plans.catalog import EXTRACT_PATTERNS, FALLBACK_SEARCHES, LIKE_TEXT, ROUTED_SEARCHES, SEARCHES, STORE_SEARCHES
from tidemark.plans.views import with_views

ORACLES: dict[str, str] = {}


def text_literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def re_literal(regex: str, flags: str = "") -> str:
    return text_literal((f"(?{flags})" if flags else "") + regex)


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


# --- ledger --------------------------------------------------------------------------------

_PRICED = """
, price AS (SELECT provider, arg_min(price_in, tier) AS price_in, arg_min(price_out, tier) AS price_out
 FROM prices {tier} GROUP BY provider)
, ledger AS (SELECT l.*, round(CAST(tokens_in AS DECIMAL(18,0)) * CAST(coalesce(price_in, 0) AS DECIMAL(10,4)) * CAST(0.000001 AS DECIMAL(6,6))
  + CAST(tokens_out AS DECIMAL(18,0)) * CAST(coalesce(price_out, 0) AS DECIMAL(10,4)) * CAST(0.000001 AS DECIMAL(6,6)), 8) AS cost
 FROM ledger_raw l LEFT JOIN price USING (provider))
, recent AS (SELECT * FROM ledger WHERE ts > (SELECT max(ts) FROM ledger) - INTERVAL 24 HOUR)
"""
_REPORT = """count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
 CAST(round(sum(cost), 6) AS DOUBLE) AS cost_usd,
 round(CAST(sum(CAST(quality_score AS DECIMAL(12,6))) AS DOUBLE) / count(*), 3) AS avg_quality,
 round(CAST(sum(latency_ms) AS DOUBLE) / count(*), 1) AS avg_latency_ms,
 count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'failed') AS failures,
 count(*) FILTER (status = 'rejected') AS rejections"""
_BASELINE = "(CAST(i AS DECIMAL(18,0)) * 15.00 * CAST(0.000001 AS DECIMAL(6,6)) + CAST(o AS DECIMAL(18,0)) * 75.00 * CAST(0.000001 AS DECIMAL(6,6)))"


def ledger_sql(body: str, tier: str = "") -> str:
    return with_views(["prices", "ledger_raw"], _PRICED.format(tier=tier) + body)


ORACLES["rolling_costs_provider"] = ledger_sql(f"SELECT provider, model, {_REPORT} FROM recent GROUP BY provider, model")
ORACLES["rolling_costs_role"] = ledger_sql("""
SELECT role, count(*) AS requests, CAST(round(sum(cost), 6) AS DOUBLE) AS cost_usd,
 CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out
FROM recent WHERE role IS NOT NULL GROUP BY role""")
ORACLES["rolling_costs_total"] = ledger_sql(f"""
, t AS (SELECT coalesce(sum(tokens_in), 0) AS i, coalesce(sum(tokens_out), 0) AS o, coalesce(sum(cost), 0) AS c FROM recent)
SELECT CAST(round(c, 6) AS DOUBLE) AS total_cost_usd, CAST(round({_BASELINE}, 4) AS DOUBLE) AS baseline_usd,
 CAST(round({_BASELINE} - c, 4) AS DOUBLE) AS savings_usd,
 CASE WHEN {_BASELINE} > 0 THEN round(CAST({_BASELINE} - c AS DOUBLE) / CAST({_BASELINE} AS DOUBLE) * 100, 1) ELSE 0.0 END AS savings_pct
FROM t""")
ORACLES["lifetime_savings"] = ledger_sql(f"""
, t AS (SELECT count(*) AS n, coalesce(sum(tokens_in), 0) AS i, coalesce(sum(tokens_out), 0) AS o, coalesce(sum(cost), 0) AS c
 FROM ledger WHERE status = 'success')
SELECT n AS total_requests, CAST(i AS BIGINT) AS total_tokens_in, CAST(o AS BIGINT) AS total_tokens_out,
 CAST(round(c, 6) AS DOUBLE) AS actual_cost_usd, CAST(round({_BASELINE}, 4) AS DOUBLE) AS baseline_usd,
 CAST(round({_BASELINE} - c, 4) AS DOUBLE) AS total_saved_usd FROM t""")
ORACLES["cost_report"] = ledger_sql(f"""
SELECT 'provider' AS level, provider, model, CAST(NULL AS VARCHAR) AS role, {_REPORT} FROM ledger GROUP BY provider, model
UNION ALL SELECT 'role', NULL, NULL, role, {_REPORT} FROM ledger WHERE role IS NOT NULL GROUP BY role
UNION ALL SELECT 'total', NULL, NULL, NULL, {_REPORT} FROM ledger""")
ORACLES["cells_rolling_costs"] = ORACLES["rolling_costs_provider"]
ORACLES["cells_lifetime_savings"] = ORACLES["lifetime_savings"]
ORACLES["gate_outcomes"] = with_views(["ledger_raw"], """
SELECT CASE WHEN quality_score >= 0.5 THEN 'passed' WHEN status = 'rejected' THEN 'rejected' ELSE 'failed' END AS outcome,
 count(*) AS requests FROM ledger_raw GROUP BY 1""")
ORACLES["request_costs"] = ledger_sql("SELECT request_id, provider, CAST(cost AS DOUBLE) AS cost_usd FROM ledger")
ORACLES["request_costs_first_tier"] = ledger_sql(
    "SELECT request_id, provider, CAST(cost AS DOUBLE) AS cost_usd FROM ledger", "WHERE tier = 1")
ORACLES["chain_order"] = with_views(["prices", "ledger_raw"], """
, p AS (SELECT *, CASE WHEN provider = 'ollama' THEN 1 ELSE 0 END AS last,
  CASE WHEN provider = 'ollama' THEN 0.0 ELSE CAST(price_in + price_out AS DOUBLE) / 2 END AS mean
 FROM prices WHERE provider IN (SELECT provider FROM ledger_raw))
SELECT provider, CAST(row_number() OVER (ORDER BY last, mean, declared_pos) AS INT) AS chain_pos, round(mean, 4) AS mean_price FROM p""")
ORACLES["model_lookup"] = with_views(["prices", "requests"], """
SELECT request_id, requested_model, model_provider FROM requests LEFT JOIN (
 SELECT model, arg_min(provider, declared_pos) AS model_provider FROM prices WHERE tier = 1 GROUP BY model) m
ON requested_model = m.model""")
ORACLES["known_providers"] = with_views(["prices", "requests"], """
SELECT request_id, target_provider FROM requests WHERE target_provider IN (SELECT provider FROM prices WHERE tier = 1)""")
ORACLES["unknown_providers"] = with_views(["prices", "requests"], """
SELECT request_id, target_provider, 'unknown_provider' AS status FROM requests
WHERE target_provider NOT IN (SELECT provider FROM prices WHERE tier = 1)""")

# --- attempts ------------------------------------------------------------------------------

_FIRST = """
, won AS (SELECT request_id, min(chain_pos) AS chain_pos FROM attempts WHERE status = 'success' AND chain_pos <= 6 GROUP BY request_id)
, w AS (SELECT a.* FROM attempts a JOIN won USING (request_id, chain_pos) WHERE status = 'success')
, e0 AS (SELECT request_id, chain_pos, provider || ': ' || coalesce(error, 'None') AS said, count(*) AS n
 FROM attempts WHERE status IS DISTINCT FROM 'success' AND chain_pos <= 6 GROUP BY ALL)
, e AS (SELECT request_id, string_agg(said || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, '; ' ORDER BY chain_pos, said) AS errors FROM e0 GROUP BY request_id)
, first AS (SELECT r.request_id, coalesce(w.provider, 'none') AS provider,
 CASE WHEN w.request_id IS NULL THEN 'failed' ELSE 'success' END AS status, w.chain_pos, w.latency_ms,
 CASE WHEN w.request_id IS NULL THEN coalesce(e.errors, '') END AS error, stray_attempts
FROM (SELECT request_id, count(*) FILTER (chain_pos > 6) AS stray_attempts FROM attempts GROUP BY request_id) r
LEFT JOIN w ON w.request_id = r.request_id LEFT JOIN e ON e.request_id = r.request_id)
"""
ORACLES["first_success"] = with_views(["attempts"], _FIRST + "SELECT * FROM first")
_STREAKS = """
, made AS (SELECT * FROM attempts WHERE status IN ('success', 'failed', 'rejected') AND provider IS NOT NULL)
, s1 AS (SELECT *, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER w AS island FROM made
 WINDOW w AS (PARTITION BY provider ORDER BY ts_s, request_id, chain_pos ROWS UNBOUNDED PRECEDING))
, s2 AS (SELECT *, CAST(sum(CASE WHEN status = 'success' THEN 0 ELSE 1 END) OVER (PARTITION BY provider, island
 ORDER BY ts_s, request_id, chain_pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM s1)
, s3 AS (SELECT *, max(CASE WHEN status <> 'success' AND streak >= 3 THEN ts_s + 60 END) OVER (PARTITION BY provider
 ORDER BY ts_s, request_id, chain_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_until_s FROM s2)
, s4 AS (SELECT *, coalesce(ts_s < open_until_s, false) AS made_while_open FROM s3)
"""
ORACLES["failure_streaks"] = with_views(["attempts"], _STREAKS + """
SELECT provider, request_id, chain_pos, ts_s, streak, open_until_s, made_while_open FROM s4""")
ORACLES["open_intervals"] = with_views(["attempts"], _STREAKS + """
SELECT provider, ts_s AS opened_s, ts_s + 60 AS open_until_s, streak FROM s4 WHERE status <> 'success' AND streak >= 3""")
ORACLES["attempts_while_open"] = with_views(["attempts"], _STREAKS + """
SELECT provider, count(*) AS attempts, count(*) FILTER (made_while_open) AS while_open,
 count(*) FILTER (made_while_open AND status = 'success') AS while_open_ok FROM s4 GROUP BY provider""")
ORACLES["provider_health"] = with_views(["attempts", "prices"], _STREAKS + """
, l AS (SELECT provider, streak, CASE WHEN status <> 'success' AND streak >= 3 THEN ts_s + 60 ELSE open_until_s END AS until,
 row_number() OVER (PARTITION BY provider ORDER BY ts_s DESC, request_id DESC, chain_pos DESC) AS r FROM s4)
, g AS (SELECT provider, count(*) AS total_requests, count(*) FILTER (status = 'success') AS total_successes,
 count(*) FILTER (status <> 'success') AS total_failures,
 CAST(sum(CASE WHEN status = 'success' THEN latency_ms END) AS DOUBLE) AS latency FROM s4 GROUP BY provider)
SELECT p.provider, coalesce(total_requests, 0) AS total_requests, coalesce(total_successes, 0) AS total_successes, coalesce(total_failures, 0) AS total_failures,
 coalesce(round(latency / nullif(total_successes, 0), 1), 0.0) AS avg_latency_ms, coalesce(streak, 0) AS consecutive_failures,
 coalesce((SELECT max(ts_s) + 1 FROM attempts) >= until, true) AS available, NOT coalesce((SELECT max(ts_s) + 1 FROM attempts) >= until, true) AS circuit_open
FROM (SELECT DISTINCT provider FROM prices) p LEFT JOIN (SELECT * FROM g JOIN l USING (provider) WHERE r = 1) h ON h.provider = p.provider""")

# --- quality -------------------------------------------------------------------------------


def any_match(text: str, patterns: list[tuple[str, str]]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {re_literal(p, f)})" for p, f in patterns) + ")"


def quality_ctes(source: str, key: str, text: str) -> str:
    """CTE q: key, text, s and the four penalties. A run of one character is found by counting
    islands of equal characters, as the regex dialect has no back reference."""
    count = {m: f"(length(s) - length(replace(s, '{m}', '')))" for m in "{}[]"}
    marks = ", ".join(text_literal(m) for m in rules.TERMINAL_MARKS if m != "\n") + ", chr(10)"
    return f"""
, q0 AS (SELECT {key} AS k, coalesce({text}, '') AS text, {strip_sql(f"coalesce({text}, '')")} AS s FROM {source})
, q1 AS (SELECT k, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM q0)
, q2 AS (SELECT k, c, i - row_number() OVER (PARTITION BY k, c ORDER BY i) AS island FROM q1 WHERE c <> chr(10))
, q3 AS (SELECT DISTINCT k FROM (SELECT k, c, island FROM q2 GROUP BY k, c, island HAVING count(*) >= 21) r)
, q4 AS (SELECT q0.*, q3.k IS NOT NULL AS repeats, regexp_matches(s, {re_literal(rules.NON_ASCII_RUN_PATTERN)}) AS noise,
  length(s) > 200 AND right(s, 1) NOT IN ({marks}) AS cut_off,
  (starts_with(s, '{{') OR starts_with(s, '[')) AND (abs({count['{']} - {count['}']}) > 1 OR abs({count['[']} - {count[']']}) > 1) AS unbalanced,
  {any_match('text', rules.TAG_PATTERNS)} AS tags, {any_match('text', rules.INJECTION_PATTERNS)} AS markers
 FROM q0 LEFT JOIN q3 ON q0.k = q3.k)
, q AS (SELECT *, CAST(CASE WHEN tags THEN -0.4 ELSE 0 END AS DOUBLE) AS xml_hallucination,
  CAST(CASE WHEN s = '' OR unbalanced THEN -0.2 ELSE 0 END AS DOUBLE) AS formatting_violation,
  CAST(CASE WHEN markers THEN -0.5 ELSE 0 END AS DOUBLE) AS prompt_injection,
  CAST(CASE WHEN length(s) < 10 OR repeats OR noise THEN -0.3 WHEN cut_off THEN -0.15 ELSE 0 END AS DOUBLE) AS coherence FROM q4)
, qs AS (SELECT *, greatest(0e0, least(1e0, 1e0 + xml_hallucination + formatting_violation + prompt_injection + coherence)) AS raw FROM q)
"""


_PROBE = quality_ctes("probe_text", "doc_id", "text")
for _name, _column in [
    ("quality_xml", "xml_hallucination"), ("quality_formatting", "formatting_violation"),
    ("quality_injection", "prompt_injection"), ("quality_coherence", "coherence"),
]:
    ORACLES[_name] = with_views(["probe_text"], _PROBE + f"SELECT k AS doc_id, {_column} FROM q")
ORACLES["quality_score"] = with_views(["probe_text"], _PROBE + """
SELECT k AS doc_id, round(raw, 3) AS score, raw >= 0.5 AS passed, xml_hallucination, formatting_violation, prompt_injection, coherence FROM qs""")


def hits_sql(patterns: list[tuple[str, str]], per_pattern: int) -> str:
    lists = [f"(regexp_extract_all(text, {re_literal(p, f)}))[1:{per_pattern}]" for p, f in patterns]
    return f"(flatten([{', '.join(lists)}]))[1:5]"


def all_hits_sql(patterns: list[tuple[str, str]]) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all(text, {re_literal(p, f)})" for p, f in patterns) + "])"


ORACLES["quality_details"] = with_views(["probe_text"], _PROBE + f"""
SELECT k AS doc_id, array_to_string(list_filter([
 CASE WHEN tags THEN 'XML hallucination detected: ' || array_to_string({hits_sql(rules.TAG_PATTERNS, 3)}, ', ') END,
 CASE WHEN s = '' THEN 'Empty response' WHEN unbalanced THEN 'Unbalanced brackets in JSON-like response' END,
 CASE WHEN markers THEN 'Prompt injection markers: ' || array_to_string(list_transform({hits_sql(rules.INJECTION_PATTERNS, 2)}, lambda h: trim(h, chr(10) || ' ')), ', ') END,
 CASE WHEN s = '' THEN 'Empty response' END,
 CASE WHEN s <> '' AND length(s) < 10 THEN 'Suspiciously short response (' || length(s) || ' chars)' END,
 CASE WHEN repeats THEN 'Repeated character pattern detected' END,
 CASE WHEN noise THEN 'Excessive non-ASCII character sequence' END,
 CASE WHEN cut_off THEN 'Response may be truncated (no terminal punctuation)' END], lambda d: d IS NOT NULL), ' | ') AS details,
 array_to_string(flatten([{all_hits_sql(rules.TAG_PATTERNS)}, {all_hits_sql(rules.INJECTION_PATTERNS)}]), ' | ') AS findings FROM q""")

# --- safety --------------------------------------------------------------------------------

_FLAT = """
, flat AS (SELECT request_id, turn, coalesce(role, 'user') AS role, CASE
 WHEN json_type(content) = 'ARRAY' THEN coalesce(array_to_string(list_filter(list_transform(json_extract(content, '$[*]'), lambda b: CASE
   WHEN json_type(b) = 'VARCHAR' THEN json_extract_string(b, '$')
   WHEN json_type(b) = 'OBJECT' AND json_extract_string(b, '$.type') = 'text' THEN coalesce(json_extract_string(b, '$.text'), '') END),
   lambda t: t IS NOT NULL), chr(10)), '')
 ELSE coalesce(json_extract_string(content, '$'), '') END AS text FROM chat_messages)
"""
ORACLES["flatten_messages"] = with_views(["chat_messages"], _FLAT + "SELECT request_id, turn, role, text FROM flat")
ORACLES["system_messages"] = with_views(["chat_messages", "system_prompts"], _FLAT + """
SELECT request_id, turn, role, text FROM flat UNION ALL
SELECT request_id, -1, 'system', CASE WHEN json_type(content) = 'ARRAY'
 THEN json_extract_string(content, '$[0].text') || chr(10) || json_extract_string(content, '$[1]')
 ELSE json_extract_string(content, '$') END
FROM system_prompts WHERE content IS NOT NULL AND content <> '[]'""")
_HITS = ", hits AS (" + " UNION ALL ".join(
    f"SELECT request_id, turn, {i} AS no, {text_literal(p)} AS pattern FROM flat WHERE regexp_matches(text, {re_literal(p, 'i')})"
    for i, p in enumerate(rules.DANGEROUS_PATTERNS)
) + ")\n"
ORACLES["safety_messages"] = with_views(["chat_messages"], _FLAT + _HITS + """
SELECT request_id, turn, CAST(row_number() OVER (PARTITION BY request_id, turn ORDER BY no) - 1 AS INT) AS hit_no, pattern FROM hits""")
ORACLES["safety_verdicts"] = with_views(["chat_messages"], _FLAT + _HITS + """
, n AS (SELECT request_id, no, pattern, count(*) AS n FROM hits GROUP BY request_id, no, pattern)
, j AS (SELECT request_id, CAST(sum(n) AS BIGINT) AS hits, string_agg(pattern || ' x' || n, '; ' ORDER BY no) AS patterns FROM n GROUP BY request_id)
SELECT r.request_id, j.hits IS NULL AS safe, coalesce(j.hits, 0) AS hits, coalesce(j.patterns, '') AS blocked_patterns
FROM (SELECT DISTINCT request_id FROM flat) r LEFT JOIN j ON r.request_id = j.request_id""")


def scrub_sql(text: str) -> str:
    for _, regex, flags, replacement, _ in rules.CREDENTIAL_RULES:
        replaced = replacement.replace("$1", "\\1").replace("$3", "\\3")
        text = f"regexp_replace({text}, {re_literal(regex, flags)}, {text_literal(replaced)}, 'g')"
    return text


ORACLES["scrubbed_text"] = with_views(["probe_text"], f"""
SELECT doc_id, {scrub_sql('text')} AS text, {scrub_sql('text')} <> text AS changed
FROM (SELECT doc_id, coalesce(text, '') AS text FROM probe_text) p""")


def placeholder_sql(value: str) -> str:
    plain = f"replace(replace(lower({value}), '-', ' '), '_', ' ')"
    markers = "[" + ", ".join(text_literal(w) for w in rules.PLACEHOLDER_WORDS) + "]"
    whole = ", ".join(text_literal(w) for w in rules.PLACEHOLDER_STRINGS)
    return (
        f"(len(list_intersect(list_distinct(string_split({plain}, ' ')), {markers})) >= 2"
        f" OR {plain} IN ({whole}) OR length({value}) < 12)"
    )


def _inventory() -> str:
    steps, text = [], "text"
    for kind, regex, flags, replacement, group in rules.CREDENTIAL_RULES:
        steps.append(f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all({text}, {re_literal(regex, flags)}, {group})) AS v FROM probe_text")
        replaced = replacement.replace("$1", "\\1").replace("$3", "\\3")
        text = f"regexp_replace({text}, {re_literal(regex, flags)}, {text_literal(replaced)}, 'g')"
    return ", found AS (" + " UNION ALL ".join(steps) + f""")
, inv AS (SELECT doc_id, kind, CASE WHEN length(v) > 12 THEN left(v, 4) || '...' || right(v, 4) ELSE '****' END AS masked,
 sha256(v) AS value_hash, {placeholder_sql('v')} AS placeholder FROM found)
"""


ORACLES["secret_inventory"] = with_views(["probe_text"], _inventory() + "SELECT doc_id, kind, masked, value_hash, placeholder FROM inv")
ORACLES["secret_counts"] = with_views(["probe_text"], _inventory() + """
SELECT kind, count(*) AS findings, count(*) FILTER (placeholder) AS placeholders FROM inv GROUP BY kind""")
ORACLES["placeholder_keys"] = with_views(["key_values"], f"SELECT id, {placeholder_sql('value')} AS placeholder FROM key_values")

# --- events --------------------------------------------------------------------------------

_EVENTS = """
, ev AS (SELECT event_id, payload, json_extract_string(payload, '$.tool_name') AS tool, json_type(payload, '$.tool_input') AS kind,
  json_extract_string(payload, '$.tool_input') AS plain FROM hook_events WHERE json_valid(payload))
"""
_GATE = "coalesce(" + ", ".join(
    [f"CASE WHEN regexp_matches(command, {re_literal(p, 'i')}) THEN '{n}' END" for n, p in reversed(rules.SHELL_LINE_PATTERNS)]
    + [f"CASE WHEN contains(lower(command), {text_literal(s.lower())}) THEN {text_literal(s)} END" for s in reversed(rules.SHELL_STRINGS)]
) + ")"
_COMMANDS = _EVENTS + f"""
, cmd AS (SELECT event_id, CASE WHEN kind = 'OBJECT' THEN json_extract_string(payload, '$.tool_input.command') ELSE plain END AS command
 FROM ev WHERE tool IN ('Bash', 'bash'))
, gated AS (SELECT *, {_GATE} AS matched FROM cmd WHERE command <> '')
"""
ORACLES["shell_gate"] = with_views(["hook_events"], _COMMANDS + "SELECT event_id, command, matched, matched IS NOT NULL AS blocked FROM gated")
ORACLES["blocked_audit"] = with_views(["hook_events"], _COMMANDS + """
SELECT event_id, command, 'safety' AS tag, 'BLOCKED command (matched: ' || matched || '): ' || left(command, 500) AS text FROM gated WHERE matched IS NOT NULL""")
# A blank after each string and separator, then none between a string and what follows it.
def escaped_sql(text: str) -> str:
    """Characters beyond printable ASCII as UTF-16 escapes."""
    return rf"""array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN c BETWEEN ' ' AND '~' THEN c
 WHEN unicode(c) < 65536 THEN format('\u{{:04x}}', unicode(c))
 ELSE format('\u{{:04x}}\u{{:04x}}', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '')"""


def spaced_sql(text: str) -> str:
    return rf"""regexp_replace(regexp_replace({escaped_sql(text)}, '("(?:[^"\\]|\\.)*")|([,:])', '\1\2 ', 'g'), '" ([,:}}\]])', '"\1', 'g')"""


_CONTEXT = f"""
, c0 AS (SELECT event_id, CASE WHEN kind IS NULL THEN '{{}}' WHEN kind = 'OBJECT' THEN
   coalesce(nullif(json_extract_string(payload, '$.tool_input.content'), ''), nullif(json_extract_string(payload, '$.tool_input.text'), ''), {spaced_sql("CAST(json_extract(payload, '$.tool_input') AS VARCHAR)")})
   WHEN kind = 'VARCHAR' THEN plain ELSE {spaced_sql("CAST(json_extract(payload, '$') AS VARCHAR)")} END AS c,
  json_extract_string(payload, '$.tool_result') AS r,
  coalesce(json_extract_string(payload, '$.cwd'), 'unknown') AS project, coalesce(json_extract_string(payload, '$.session_id'), 'unknown') AS session_id FROM ev)
, c1 AS (SELECT event_id, CASE WHEN length(r) > 100 THEN c || chr(10) || chr(10) || '--- tool_result ---' || chr(10) || r ELSE c END AS context, project, session_id FROM c0)
"""
ORACLES["payload_context"] = with_views(["hook_events"], _EVENTS + _CONTEXT + """
SELECT event_id, context, project, session_id FROM c1 WHERE length(context) >= 100""")
ORACLES["quarantined_payloads"] = with_views(["hook_events"], "SELECT event_id, payload FROM hook_events WHERE NOT json_valid(payload)")
ORACLES["compaction_events"] = with_views(["hook_events"], _EVENTS + """
SELECT event_id, tool AS tool_name, CAST(strlen(payload) AS INT) AS payload_bytes FROM ev
WHERE regexp_matches(tool, '[Cc]ompact|[Ss]ummariz|[Cc]ompress')""")
ORACLES["session_end_events"] = with_views(["hook_events"], _EVENTS + """
, s AS (SELECT event_id, payload, coalesce(nullif(json_extract_string(payload, '$.summary'), ''), nullif(json_extract_string(payload, '$.message'), ''),
 nullif(json_extract_string(payload, '$.stop_reason'), ''),
 CASE WHEN kind = 'VARCHAR' THEN plain ELSE coalesce(nullif(json_extract_string(payload, '$.tool_input.content'), ''), json_extract_string(payload, '$.tool_input.text')) END, '') AS content FROM ev)
SELECT event_id, content, CAST(strlen(payload) AS INT) AS payload_bytes FROM s WHERE strlen(payload) >= 50 AND length(content) > 50""")
_CANON = """
, r AS (SELECT request_id, turn, request_id * 1000 + turn AS rk, response, coalesce(json_extract_string(response, '$.choices[0].message.content'), '') AS body FROM responses)
""" + quality_ctes("r", "rk", "body") + f"""
, x AS (SELECT r.*, round(raw, 3) AS score, raw >= 0.5 AS passed, CASE WHEN raw >= 0.5 THEN {scrub_sql('body')} ELSE body END AS clean FROM r JOIN qs ON qs.k = r.rk)
, u AS (SELECT *, CAST(json_extract(response, '$.usage.prompt_tokens') AS BIGINT) AS p, CAST(json_extract(response, '$.usage.completion_tokens') AS BIGINT) AS c,
 CAST(json_extract(response, '$.usage.input_tokens') AS BIGINT) AS i, CAST(json_extract(response, '$.usage.output_tokens') AS BIGINT) AS o FROM x)
, canon AS (SELECT request_id, turn, score, coalesce(json_extract_string(response, '$.id'), '') AS id, 'message' AS type, 'assistant' AS role, clean AS text,
 coalesce(json_extract_string(response, '$.model'), '') AS model,
 CASE WHEN json_extract_string(response, '$.choices[0].finish_reason') = 'length' THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason,
 coalesce(p, 0) AS input_tokens, coalesce(c, 0) AS output_tokens,
 CASE WHEN passed THEN coalesce(p, 0) ELSE coalesce(nullif(p, 0), i, 0) END AS tokens_in, CASE WHEN passed THEN coalesce(c, 0) ELSE coalesce(nullif(c, 0), o, 0) END AS tokens_out, passed, clean <> body AS scrubbed FROM u)
"""
ORACLES["canonical_responses"] = with_views(["responses"], _CANON + "SELECT * EXCLUDE (score) FROM canon")
_REQUESTS = _FLAT + _HITS + _CANON + """
, price AS (SELECT provider, arg_min(price_in, tier) AS price_in, arg_min(price_out, tier) AS price_out FROM prices GROUP BY provider)
, known AS (SELECT provider, arg_min(model, declared_pos) AS model FROM prices WHERE tier = 1 GROUP BY provider)
, tried AS (SELECT q.request_id, a.chain_pos, a.provider, a.tried_s, a.latency_ms, a.status FROM turn_requests q JOIN turn_attempts a ON a.number = q.number
 WHERE a.tried_s BETWEEN q.asked_s AND q.asked_s + 300 AND a.chain_pos BETWEEN 0 AND 6 AND (q.target_provider IS NULL OR a.provider = q.target_provider))
, won AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY chain_pos, tried_s, provider, latency_ms) AS n FROM tried WHERE status = 'success')
, called AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tried_s DESC, chain_pos DESC, latency_ms DESC) AS n FROM tried
 WHERE status IN ('success', 'failed', 'rejected') AND provider IS NOT NULL)
, j AS (SELECT q.*, w.provider AS won_by, w.latency_ms AS won_ms, l.request_id IS NOT NULL AS was_called, l.latency_ms AS called_ms, k.model AS target_model,
  c.model, c.tokens_in AS ti, c.tokens_out AS tout, c.score,
  CASE WHEN (q.conv_id, q.turn) IN (SELECT (request_id, turn) FROM hits) THEN 'blocked' WHEN q.target_provider IS NOT NULL AND k.model IS NULL THEN 'unknown_provider'
   WHEN w.request_id IS NULL OR c.passed IS NULL THEN 'failed' WHEN NOT c.passed THEN 'rejected' ELSE 'success' END AS status
 FROM turn_requests q LEFT JOIN won w ON w.request_id = q.request_id AND w.n = 1 LEFT JOIN called l ON l.request_id = q.request_id AND l.n = 1
 LEFT JOIN known k ON k.provider = q.target_provider
 LEFT JOIN turn_replies p ON p.request_id = q.request_id AND p.replied_s BETWEEN q.asked_s AND q.asked_s + 600
 LEFT JOIN canon c ON c.request_id = p.conv_id AND c.turn = p.turn)
, k AS (SELECT request_id, status, role, CASE WHEN status = 'blocked' THEN 'safety_block' WHEN status IN ('success', 'rejected') THEN won_by ELSE coalesce(target_provider, 'none') END AS provider,
  CASE WHEN status IN ('success', 'rejected') THEN model WHEN status = 'unknown_provider' THEN coalesce(requested_model, 'unknown')
   WHEN status = 'failed' AND target_provider IS NOT NULL THEN CASE WHEN was_called THEN coalesce(requested_model, target_model) ELSE target_model END ELSE 'none' END AS model,
  CASE WHEN status = 'success' THEN ti ELSE 0 END AS tokens_in, CASE WHEN status = 'success' THEN tout ELSE 0 END AS tokens_out,
  CASE WHEN status IN ('success', 'rejected') THEN score ELSE 0e0 END AS quality_score,
  CASE WHEN status IN ('success', 'rejected') THEN won_ms WHEN status = 'failed' AND target_provider IS NOT NULL THEN coalesce(called_ms, 0) ELSE 0 END AS latency_ms FROM j)
, l AS (SELECT k.*, round(CAST(tokens_in AS DECIMAL(18,0)) * CAST(coalesce(price_in, 0) AS DECIMAL(10,4)) * CAST(0.000001 AS DECIMAL(6,6))
  + CAST(tokens_out AS DECIMAL(18,0)) * CAST(coalesce(price_out, 0) AS DECIMAL(10,4)) * CAST(0.000001 AS DECIMAL(6,6)), 8) AS cost FROM k LEFT JOIN price USING (provider))
"""
_REQUEST_VIEWS = ["chat_messages", "responses", "prices", "turn_requests", "turn_attempts", "turn_replies"]
ORACLES["request_ledger"] = with_views(_REQUEST_VIEWS, _REQUESTS + """
SELECT request_id, provider, model, status, tokens_in, tokens_out, quality_score, latency_ms, role, CAST(cost AS DOUBLE) AS cost_usd FROM l""")
ORACLES["stream_ledger"] = ORACLES["request_ledger"]
ORACLES["request_ledger_costs"] = with_views(_REQUEST_VIEWS, _REQUESTS + """
SELECT provider, status, count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
 CAST(sum(cost) AS DOUBLE) AS cost_usd FROM l GROUP BY provider, status""")
ORACLES["dispatch_audit"] = with_views(["hook_events"], _EVENTS + """
SELECT event_id, tool AS tool_name, 'compaction' AS tag, 'Dispatched (tool=' || tool || ' payload_bytes=' || strlen(payload) || ')' AS text FROM ev
WHERE regexp_matches(tool, '[Cc]ompact|[Ss]ummariz|[Cc]ompress')""")

# --- memories ------------------------------------------------------------------------------


def items_ctes() -> str:
    s = strip_sql
    return rf"""
, o1 AS (SELECT run_id, run_part, category, context_length, {s('output')} AS t FROM model_outputs)
, o2 AS (SELECT *, CASE WHEN starts_with(t, '```') THEN regexp_replace(regexp_replace(t, '^[^\n]*(\n|$)', ''), '(?s)^(.*\n|)[^\S\n]*```.*$', '\1') ELSE t END AS u FROM o1)
, o3 AS (SELECT *, regexp_extract(u, '(?s)\[.*\]') AS j FROM o2)
, o4 AS (SELECT run_id, run_part, category, context_length, CASE WHEN json_valid(j) THEN json_extract(j, '$[*]') ELSE [] END AS els FROM o3)
, o5 AS (SELECT run_id, run_part, category, unnest(els) AS el, generate_subscripts(els, 1) - 1 AS pos FROM o4)
, o6 AS (SELECT *, json_type(el, '$.text') AS tk, {s("json_extract_string(el, '$.text')")} AS content, json_type(el, '$.importance') AS ik,
  json_extract_string(el, '$.importance') AS iv, json_extract_string(el, '$.subcategory') AS sub FROM o5 WHERE json_type(el) = 'OBJECT')
, o7 AS (SELECT *, CASE WHEN ik IS NULL THEN 5 WHEN ik IN ('UBIGINT', 'BIGINT') THEN CAST(iv AS BIGINT) WHEN ik = 'DOUBLE' THEN CAST(trunc(CAST(iv AS DOUBLE)) AS BIGINT)
  WHEN ik = 'VARCHAR' AND regexp_matches(iv, '^\s*[+-]?\d+\s*$') THEN CAST(trim(iv) AS BIGINT) END AS importance,
  tk IS NULL OR (tk = 'VARCHAR' AND content = '') AS blank FROM o6)
, lost AS (SELECT DISTINCT run_id, run_part, category FROM o7 WHERE NOT blank AND (tk <> 'VARCHAR' OR importance IS NULL))
, items AS (SELECT run_id, run_part, category, CASE category WHEN 'fact' THEN 1 WHEN 'decision' THEN 2 ELSE 3 END AS cat_order,
  CAST(pos AS INT) AS pos, content, importance,
  coalesce(sub, CASE category WHEN 'fact' THEN 'reference' WHEN 'decision' THEN 'strategy' ELSE 'how_to' END) AS subcategory
 FROM o7 WHERE NOT blank AND (run_id, run_part, category) NOT IN (SELECT (run_id, run_part, category) FROM lost))
, keyed AS (SELECT *, sha256(category || ':' || subcategory || ':' || content) AS commit_hash FROM items WHERE importance >= 7)
, committed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash ORDER BY run_id, run_part, cat_order, pos) AS r FROM keyed) k WHERE r = 1)
, runs AS (SELECT run_id, run_part, CAST(max(context_length) AS BIGINT) AS context_length,
  (SELECT count(*) FROM items i WHERE i.run_id = m.run_id AND i.run_part = m.run_part) AS extracted,
  (SELECT count(*) FROM committed c WHERE c.run_id = m.run_id AND c.run_part = m.run_part) AS committed
 FROM model_outputs m GROUP BY run_id, run_part)
"""


_ITEM = "run_id, run_part, category, pos, content, importance, subcategory"
for _name, _body in {
    "parsed_items": f"SELECT {_ITEM} FROM items",
    "failed_outputs": "SELECT run_id, run_part, category FROM lost",
    "committed_memories": f"SELECT commit_hash, {_ITEM} FROM committed",
    "committed_to_store": f"SELECT commit_hash, {_ITEM} FROM committed WHERE NOT (content = 'shared' AND category = 'fact')",
    "run_summary": "SELECT run_id, run_part, context_length, extracted, committed FROM runs",
    "recent_runs": "SELECT run_id, run_part, context_length, extracted, committed FROM runs ORDER BY run_id DESC, run_part DESC LIMIT 10",
}.items():
    ORACLES[_name] = with_views(["model_outputs"], items_ctes() + _body)

ORACLES["rule_facts"] = with_views(["contexts"], " UNION ALL ".join(
    f"SELECT context_id, 'fact' AS category, '{kind}' AS kind, '{sub}' AS subcategory, CAST({imp} AS BIGINT) AS importance,"
    f" unnest(list_distinct(regexp_extract_all(context, {re_literal(regex)}))) AS content FROM contexts"
    for kind, sub, imp, regex in rules.FACT_RULES
))
_CUES = [f"WHEN regexp_matches(content, {re_literal(cue, 'i')}) THEN " for *_, cue in rules.SENTENCE_RULES]
ORACLES["rule_sentences"] = with_views(["contexts"], rf"""
, s AS (SELECT context_id, {strip_sql("unnest(string_split_regex(context, '[.!?\n]+'))")} AS content,
  CAST(generate_subscripts(string_split_regex(context, '[.!?\n]+'), 1) - 1 AS INT) AS sentence_no FROM contexts)
, h AS (SELECT *, CASE {" ".join(cue + str(i) for i, cue in enumerate(_CUES))} END AS hit FROM s)
SELECT context_id, sentence_no, """ + ", ".join(
    f"CASE hit {' '.join(f'WHEN {i} THEN {value(rule)}' for i, rule in enumerate(rules.SENTENCE_RULES))} END AS {column}"
    for column, value in [
        ("category", lambda r: text_literal(r[0])), ("subcategory", lambda r: text_literal(r[1])),
        ("importance", lambda r: f"CAST({r[2]} AS BIGINT)"),
    ]
) + ", content FROM h WHERE hit IS NOT NULL")
_EXTRACTED = ", x AS (" + " UNION ALL ".join(
    f"SELECT *, '{category}' AS category, '{subcategory}' AS subcategory, regexp_extract_all(context, {re_literal(EXTRACT_PATTERNS[category])}) AS found FROM {{source}}"
    for category, subcategory in rules.DEFAULT_SUBCATEGORY.items()
) + ")"
ORACLES["model_extraction"] = with_views(["contexts"], _EXTRACTED.replace("{source}", "contexts") + f"""
SELECT context_id AS run_id, category, CAST(i - 1 AS INT) AS pos, {strip_sql('content')} AS content, CAST(8 AS BIGINT) AS importance, subcategory,
 length(context) AS context_length
FROM (SELECT *, unnest(found) AS content, generate_subscripts(found, 1) AS i FROM x) y""")
ORACLES["extraction_errors"] = with_views(["contexts"], _EXTRACTED.replace("{source}", "contexts") + """
SELECT context_id AS run_id, category, 'ValueError: no skill found' AS error FROM x WHERE category = 'skill' AND len(found) = 0""")
ORACLES["memory_stats"] = with_views(["memories"], """
SELECT 'total' AS section, 'all' AS name, count(*) AS memories FROM memories UNION ALL
SELECT 'category', category, count(*) FROM memories GROUP BY category""")
ORACLES["top_projects"] = with_views(["memories"], """
SELECT coalesce(project, 'unassigned') AS project, count(*) AS memories FROM memories GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
ORACLES["recent_memories"] = with_views(["memories"], rf"""
, m AS (SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY created_s DESC, mem_id DESC) AS INT) AS place, mem_id, category,
 {strip_sql('content')} AS c FROM memories WHERE project IS NOT NULL)
SELECT project, regexp_extract(project, '[^/]*$') AS project_name, place, mem_id,
 '[' || upper(category) || '] ' || CASE WHEN length(c) > 120 THEN left(c, 117) || '...' ELSE c END AS line FROM m WHERE place <= 5""")

# --- search --------------------------------------------------------------------------------

_TOKEN = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
_COLUMNS = ["content", "category", "subcategory", "project"]


def stem_ctes(source: str, prefix: str) -> str:
    """CTE <prefix>: token and stem of the distinct tokens of source, Porter's steps one by one."""
    v, m1, m2 = "[aeiouy]", "[aeiouy][^aeiouy]", "[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]"
    short = "[^aeiouy][aeiouy][bcdfghjklmnpqrstvz0-9]$"
    ctes, last = [], f"{prefix}0"

    def add(body: str) -> None:
        nonlocal last
        name = f"{prefix}{len(ctes) + 1}"
        ctes.append(f", {name} AS (SELECT {body} FROM {last})")
        last = name

    def cut(suffixes) -> None:
        pattern = ".(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$"
        add(f"token, w, regexp_extract(w, '{pattern}', 1) AS s")
        add("token, w, s, left(w, length(w) - length(s)) AS b")

    def swap(mapping, condition) -> None:
        cut(mapping)
        ends = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items())
        test = f"AND regexp_matches(b, '{condition}')" if condition else ""
        add(f"token, CASE WHEN s <> '' {test} THEN b || CASE s {ends} END ELSE w END AS w")

    swap({"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, None)
    cut(["eed", "ed", "ing"])
    add(f"token, CASE WHEN s = 'eed' AND regexp_matches(b, '{m1}') THEN b || 'ee' WHEN s IN ('ed', 'ing') AND regexp_matches(b, '{v}') THEN b ELSE w END AS w,"
        f" s IN ('ed', 'ing') AND regexp_matches(b, '{v}') AS t")
    add(f"token, CASE WHEN NOT t THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'"
        f" WHEN regexp_matches(w, '[bcdfghjkmnpqrtvwx0-9]$') AND length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) THEN left(w, length(w) - 1)"
        f" WHEN regexp_matches(w, '{m1}') AND NOT regexp_matches(w, '{m2}') AND regexp_matches(w, '{short}') THEN w || 'e' ELSE w END AS w")
    add(f"token, CASE WHEN regexp_matches(w, '[yY]$') AND regexp_matches(left(w, length(w) - 1), '{v}') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w")
    swap(rules.STEM_STEP_2, m1)
    swap(rules.STEM_STEP_3, m1)
    cut(rules.STEM_STEP_4)
    add(f"token, CASE WHEN s <> '' AND regexp_matches(b, '{m2}') AND (s <> 'ion' OR regexp_matches(b, '[st]$')) THEN b ELSE w END AS w")
    add("token, w, left(w, length(w) - 1) AS b")
    add(f"token, CASE WHEN ends_with(w, 'e') AND (regexp_matches(b, '{m2}') OR (regexp_matches(b, '{m1}') AND NOT regexp_matches(b, '{short}'))) THEN b ELSE w END AS w")
    add(f"token, CASE WHEN ends_with(w, 'll') AND regexp_matches(left(w, length(w) - 1), '{m2}') THEN left(w, length(w) - 1) ELSE w END AS w")
    first = f", {prefix}0 AS (SELECT DISTINCT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {source})"
    end = f", {prefix} AS (SELECT token, CASE WHEN strlen(token) BETWEEN 3 AND 64 THEN lower(w) ELSE token END AS stem FROM {last})"
    return "\n".join([first, *ctes, end]) + "\n"


def _corpus() -> str:
    parts = " UNION ALL ".join(
        f"SELECT mem_id, '{c}' AS col, generate_subscripts({_TOKEN.format(f'coalesce({c}, {chr(39)*2})')}, 1) AS pos,"
        f" unnest({_TOKEN.format(f'coalesce({c}, {chr(39)*2})')}) AS token FROM memories"
        for c in _COLUMNS
    )
    return f", toks AS MATERIALIZED ({parts})\n"


def _ranked(rows: list[tuple], limit: int = 10) -> str:
    values = ", ".join("(" + ", ".join([str(r[0]), *[text_literal(x) for x in r[1:]]]) + ")" for r in rows)
    return _corpus() + stem_ctes("toks", "voc") + f"""
, qs AS (SELECT * FROM (VALUES {values}) t(query_id, query, mode, col, project, category))
, q1 AS (SELECT *, CASE WHEN mode = 'phrase' THEN [query] ELSE string_split(query, ' ') END AS words FROM qs)
, q2 AS (SELECT query_id, mode, col, unnest(words) AS word, generate_subscripts(words, 1) AS unit FROM q1)
, q3 AS (SELECT query_id, mode, col, unit, {_TOKEN.format('word')} AS ts FROM q2)
, qt AS (SELECT query_id, mode, col, unit, len(ts) AS k, unnest(ts) AS token, generate_subscripts(ts, 1) AS o FROM q3)
""" + stem_ctes("qt", "qv") + f"""
, w AS (SELECT DISTINCT qt.query_id, qt.mode, qt.col AS only_col, unit, k, o, voc.token AS found FROM qt JOIN qv ON qv.token = qt.token
  JOIN voc ON CASE WHEN mode = 'prefix' AND o = k THEN starts_with(voc.stem, qv.stem) ELSE voc.stem = qv.stem END)
, h AS (SELECT query_id, mode, unit, k, mem_id, col, pos - o AS start, count(*) AS c FROM toks JOIN w ON toks.token = w.found
  WHERE only_col IS NULL OR only_col = col GROUP BY ALL)
, f AS (SELECT query_id, mode, unit, mem_id, count(*) AS f FROM h WHERE c = k GROUP BY ALL)
, n AS (SELECT query_id, unit, count(*) AS n FROM f GROUP BY ALL)
, d AS (SELECT mem_id, count(*) AS d FROM toks GROUP BY mem_id)
, st AS (SELECT (SELECT count(*) FROM memories) AS docs, (SELECT CAST(count(*) AS DOUBLE) FROM toks) / (SELECT count(*) FROM memories) AS avgd)
, p AS (SELECT f.*, d.d, avgd, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END AS idf
  FROM f JOIN n USING (query_id, unit) JOIN d USING (mem_id), st)
, sc AS (SELECT query_id, mem_id, any_value(mode) AS mode, sum(CASE WHEN mode = 'not' AND unit > 1 THEN 0 ELSE CAST(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgd)) AS DECIMAL(30,15)) END) AS rank,
  count(*) FILTER (NOT (mode = 'not' AND unit > 1)) AS met, count(*) FILTER (mode = 'not' AND unit > 1) AS unwanted FROM p GROUP BY query_id, mem_id)
, ok AS (SELECT sc.query_id, m.*, CAST(rank AS DOUBLE) AS rank, row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.rank, m.mem_id) AS place
  FROM sc JOIN qs USING (query_id) JOIN memories m USING (mem_id)
  WHERE unwanted = 0 AND met >= CASE qs.mode WHEN 'any' THEN 1 WHEN 'not' THEN 1 WHEN 'phrase' THEN 1 ELSE len(string_split(query, ' ')) END
   AND (qs.project IS NULL OR qs.project = m.project) AND (qs.category IS NULL OR qs.category = m.category))
"""


_HIT = "mem_id, category, subcategory, content, importance, project, created_s, access_count"
for _name, _rows in SEARCHES.items():
    ORACLES[_name] = with_views(["memories"], _ranked(_rows) + f"SELECT query_id, {_HIT}, round(rank, 6) AS rank FROM ok WHERE place <= 10")
ORACLES["access_touch"] = with_views(["memories"], _ranked(SEARCHES["search_any"]) + """
SELECT m.mem_id, CAST(m.access_count + (SELECT count(*) FROM ok WHERE ok.mem_id = m.mem_id AND place <= 10) AS INT) AS access_count FROM memories m""")
ORACLES["search_store"] = with_views(["model_outputs"], items_ctes() + """
, memories AS (SELECT commit_hash AS mem_id, category, subcategory, content, importance, CAST(NULL AS VARCHAR) AS project FROM committed)
""" + _ranked(STORE_SEARCHES) + "SELECT query_id, mem_id AS commit_hash, category, content, round(rank, 6) AS rank FROM ok WHERE place <= 10")
ORACLES["run_log"] = with_views(["model_outputs"], items_ctes() + """
SELECT CAST(run_id AS VARCHAR) || '/' || CAST(run_part AS VARCHAR) AS run_id, context_length, extracted, committed FROM runs""")
ORACLES["search_fallback"] = with_views(["memories"], f"""
, qs AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join([str(r[0]), *[text_literal(x) for x in r[1:]]]) + ")" for r in FALLBACK_SEARCHES)}) t(query_id, query, mode, col, project, category))
, ok AS (SELECT query_id, m.*, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, mem_id) AS place FROM memories m JOIN qs
  ON lower(m.content) LIKE '%' || lower(query) || '%' AND NOT regexp_matches(query, '[a-z]')
  AND (qs.project IS NULL OR qs.project = m.project) AND (qs.category IS NULL OR qs.category = m.category))
SELECT query_id, {_HIT}, 0e0 AS rank FROM ok WHERE place <= 10""")
_ROUTED_PLAIN = [r for r in ROUTED_SEARCHES if r[2] == "phrase" or re.fullmatch(r"(?a:[\w\s]|[^\x00-\x7f])+", r[1])]
_ROUTED_LIKE = [r for r in ROUTED_SEARCHES if r not in _ROUTED_PLAIN]
ORACLES["search_routed"] = with_views(["memories"], _ranked(_ROUTED_PLAIN) + f"""
, lq AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join([str(r[0]), *[text_literal(x) for x in r[1:]]]) + ")" for r in _ROUTED_LIKE)}) t(query_id, query, mode, col, project, category))
, lk AS (SELECT lq.query_id, m.*, row_number() OVER (PARTITION BY lq.query_id ORDER BY importance DESC, mem_id) AS place FROM memories m JOIN lq
  ON translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%' || translate(lq.query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '%'
  WHERE (lq.project IS NULL OR lq.project = m.project) AND (lq.category IS NULL OR lq.category = m.category))
SELECT query_id, {_HIT}, round(rank, 6) AS rank FROM ok WHERE place <= 10
UNION ALL SELECT query_id, {_HIT}, 0e0 AS rank FROM lk WHERE place <= 10""")
ORACLES["index_build"] = with_views(["memories"], _corpus() + stem_ctes("toks", "voc") + f"""
SELECT stem, count(DISTINCT mem_id) AS memories, {", ".join(f"count(DISTINCT mem_id) FILTER (col = '{c}') AS in_{c}" for c in _COLUMNS)}, count(*) AS occurrences
FROM toks JOIN voc USING (token) GROUP BY stem""")
ORACLES["search_like"] = with_views(["memories"], f"""
SELECT {_HIT}, 0e0 AS rank FROM memories WHERE content ILIKE '%{LIKE_TEXT}%' AND category = 'skill' ORDER BY importance DESC, mem_id LIMIT 10""")
ORACLES["term_frequencies"] = with_views(["memories"], _corpus() + "SELECT token, count(DISTINCT mem_id) AS memories FROM toks GROUP BY token")
ORACLES["corpus_stats"] = with_views(["memories"], _corpus() + """
SELECT (SELECT count(*) FROM memories) AS n_docs, count(*) AS n_tokens, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM memories), 4) AS avg_tokens FROM toks""")
ORACLES["vocabulary_stems"] = with_views(["memories"], _corpus() + stem_ctes("toks", "voc") + "SELECT token, stem FROM voc")

# --- streams -------------------------------------------------------------------------------

ORACLES["stream_gate"] = with_views(["probe_text"], _PROBE + f"""
SELECT k AS doc_id, CASE WHEN raw >= 0.5 THEN {scrub_sql('text')} ELSE text END AS text, round(raw, 3) AS score, raw >= 0.5 AS passed,
 raw >= 0.5 AND {scrub_sql('text')} <> text AS changed FROM qs""")
ORACLES["stream_commands"] = ORACLES["blocked_audit"]
ORACLES["stream_counters"] = ORACLES["gate_outcomes"]
ORACLES["stream_breaker"] = ORACLES["failure_streaks"]
ORACLES["stream_rolling_cost"] = ledger_sql("""
, h AS (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS hour_s FROM ledger)
, e AS (SELECT h.*, hour_s - o * 3600 AS start_s FROM h, range(24) r(o))
SELECT start_s, provider, model, count(*) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
 CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(cost) AS DOUBLE) AS cost_usd FROM e
GROUP BY start_s, provider, model""")
ORACLES["stream_memories"] = with_views(["hook_events"], _EVENTS + _CONTEXT + """
, s AS (SELECT event_id FROM (SELECT event_id, payload, coalesce(nullif(json_extract_string(payload, '$.summary'), ''), nullif(json_extract_string(payload, '$.message'), ''),
 nullif(json_extract_string(payload, '$.stop_reason'), ''),
 CASE WHEN kind = 'VARCHAR' THEN plain ELSE coalesce(nullif(json_extract_string(payload, '$.tool_input.content'), ''), json_extract_string(payload, '$.tool_input.text')) END, '') AS content, tool FROM ev) x
 WHERE coalesce(regexp_matches(tool, '[Cc]ompact|[Ss]ummariz|[Cc]ompress'), false) OR (strlen(payload) >= 50 AND length(content) > 50))
, c AS (SELECT context FROM c1 WHERE length(context) >= 100 AND event_id IN (SELECT event_id FROM s))
""" + _EXTRACTED.replace("{source}", "c") + f"""
, m AS (SELECT DISTINCT category, subcategory, {strip_sql('content')} AS content FROM (SELECT *, unnest(found) AS content FROM x) y)
SELECT sha256(category || ':' || subcategory || ':' || content) AS commit_hash, category, subcategory, content, CAST(8 AS BIGINT) AS importance FROM m""")
