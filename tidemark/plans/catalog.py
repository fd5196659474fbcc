"""Named queries over the given tables, one per operator group."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import rules, schemas
from tidemark.functions.safety import is_placeholder
from tidemark.operators import attempts as A
from tidemark.operators import extraction as E
from tidemark.operators import hooks as H
from tidemark.operators import ledger as L
from tidemark.operators import memories as M
from tidemark.operators import messages as C
from tidemark.operators import pricing as P
from tidemark.operators import quality as Q
from tidemark.operators import requests as N
from tidemark.operators import safety as S
from tidemark.operators import search as R
from tidemark.operators import substrings as G
from tidemark.plans.jobs import commit_outputs, log_access, with_access
from tidemark.plans.views import VIEWS, view
from tidemark.session import shared_path, stage
from tidemark.sources.payloads import parse_payloads, quarantined
from tidemark.sources.cells import append_with_cells, read_cells, rolling_cells
from tidemark.sources.ledger import append_ledger, read_ledger
from tidemark.sources.providers import default_providers
from tidemark.sources.sinks import append_audit, read_memories
from tidemark.streaming import streams as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHECK_COLUMNS = ["score", "passed", *Q.CHECKS]

# Search terms: query_id, query, mode, col, project, category.
SEARCHES = {
    "search_all": [(1, "the and", "all", None, None, None), (6, "fact", "all", None, None, None)],
    "search_any": [(2, "the leaux", "any", None, None, None), (14, "der die das", "any", None, None, None)],
    "search_phrase": [(3, "le la", "phrase", None, None, None), (5, "how_to", "phrase", None, None, None)],
    "search_prefix": [(4, "ther", "prefix", None, None, None), (15, "le que", "prefix", None, None, None)],
    "search_column": [
        (7, "home", "all", "project", None, None), (8, "skill", "all", "category", None, None),
        (9, "how", "all", "content", None, None),
    ],
    "search_not": [(10, "the of", "not", None, None, None), (11, "le les des", "not", None, None, None)],
    "search_filtered": [
        (12, "the", "all", None, None, "decision"), (13, "la", "any", None, "/home/u/src2", None),
    ],
}
SEARCHES["search_batch"] = [row for rows in SEARCHES.values() for row in rows]
LIKE_TEXT = "On_T"
# Over the committed model outputs.
STORE_SEARCHES = [
    (1, "shared", "all", None, None, None), (2, "shared fact", "any", None, None, None), (3, "a", "prefix", None, None, None),
    (4, "how_to", "phrase", None, None, None),
]
FALLBACK_SEARCHES = [
    (1, "###", "all", None, None, None), (2, "the", "all", None, None, None), (3, "&&& ***", "any", None, None, None),
    (4, "%%%", "all", None, None, "skill"), (5, "|", "all", None, "/home/u/src3", None),
]

ROUTED_SEARCHES = [
    (1, "the and", "all", None, None, None), (2, "the !!!", "all", None, None, None), (3, "and. th", "any", None, None, None),
    (4, ", de", "all", None, None, "skill"), (5, "le la", "phrase", None, None, None), (6, "on%the.", "any", None, None, None),
    (7, "no-such-text", "all", None, None, None), (8, "LICENSED under the Apache License,", "all", None, None, None),
    (9, "é.", "any", None, None, None),
]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def query_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        rows,
        "query_id int, query string, mode string, col string, project string, category string",
    )


def priced_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.priced(view(spark, sf_dir, "ledger_raw"), view(spark, sf_dir, "prices"))


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of the log, filtered before prices are joined."""
    raw = view(spark, sf_dir, "ledger_raw")
    window = L.rolling_window(raw, L.latest_ts(raw))
    return P.priced(window, view(spark, sf_dir, "prices"))


# --- ledger --------------------------------------------------------------------------------


@query
def rolling_costs_provider(spark, sf_dir):
    return L.rolling_costs(rolling(spark, sf_dir))


@query
def rolling_costs_total(spark, sf_dir):
    return L.rolling_totals(rolling(spark, sf_dir))


@query
def rolling_costs_role(spark, sf_dir):
    return L.rolling_costs_by_role(rolling(spark, sf_dir))


@query
def cost_report(spark, sf_dir):
    return L.cost_report(priced_ledger(spark, sf_dir))


@query
def lifetime_savings(spark, sf_dir):
    return L.lifetime_savings(priced_ledger(spark, sf_dir))


def ledger_with_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ledger written in two parts, the second of which falls late on every day, and its cells."""
    out = shared_path(spark, "ledger")
    rows = priced_ledger(spark, sf_dir).withColumnRenamed("request_id", "id")
    late = F.col("id") % 3 == 0
    for part in (rows.filter(~late), rows.filter(late)):
        append_with_cells(part, f"{out}/rows", f"{out}/cells")
    return read_ledger(spark, f"{out}/rows"), read_cells(spark, f"{out}/cells")


@query
def cells_rolling_costs(spark, sf_dir):
    """A1 from hour cells and the rows of one hour."""
    ledger, cells = ledger_with_cells(spark, sf_dir)
    return L.rolling_costs(rolling_cells(cells, ledger, L.latest_ts(ledger)))


@query
def cells_lifetime_savings(spark, sf_dir):
    """A4 from hour cells alone."""
    return L.lifetime_savings(ledger_with_cells(spark, sf_dir)[1])


@query
def gate_outcomes(spark, sf_dir):
    return L.gate_outcomes(view(spark, sf_dir, "ledger_raw"))


@query
def request_costs(spark, sf_dir):
    return priced_ledger(spark, sf_dir).select(
        "request_id", "provider", F.col("cost_usd").cast("double").alias("cost_usd")
    )


@query
def request_costs_first_tier(spark, sf_dir):
    prices = view(spark, sf_dir, "prices")
    return P.priced(view(spark, sf_dir, "ledger_raw"), prices, tier=1).select(
        "request_id", "provider", F.col("cost_usd").cast("double").alias("cost_usd")
    )


@query
def chain_order(spark, sf_dir):
    """Default chain over the providers that the log has seen."""
    seen = view(spark, sf_dir, "ledger_raw").select("provider").distinct()
    return P.default_chain(view(spark, sf_dir, "prices").join(seen, "provider", "left_semi"))


@query
def model_lookup(spark, sf_dir):
    found = P.provider_for_model(view(spark, sf_dir, "requests"), view(spark, sf_dir, "prices"))
    return found.select("request_id", "requested_model", "model_provider")


@query
def known_providers(spark, sf_dir):
    found = P.known_targets(view(spark, sf_dir, "requests"), view(spark, sf_dir, "prices"))
    return found.select("request_id", "target_provider")


@query
def unknown_providers(spark, sf_dir):
    found = P.unknown_targets(view(spark, sf_dir, "requests"), view(spark, sf_dir, "prices"))
    return found.select("request_id", "target_provider", "status")


def _timed(spark, sf_dir, name, at):
    """A view with its seconds as a timestamp."""
    return view(spark, sf_dir, name).withColumn(f"{at}_at", F.timestamp_seconds(f"{at}_s"))


def _last_position() -> int:
    return max(position for *_, position in rules.PROVIDERS if position)


def _request_ledger(spark, sf_dir):
    return N.request_ledger(
        _timed(spark, sf_dir, "turn_requests", "asked"), view(spark, sf_dir, "turn_messages"), _timed(spark, sf_dir, "turn_attempts", "tried"),
        _timed(spark, sf_dir, "turn_replies", "replied"), default_providers(spark), _last_position())


LEDGER_COLUMNS = ["provider", "model", "status", "tokens_in", "tokens_out", "quality_score", "latency_ms", "role"]


@query
def request_ledger(spark, sf_dir):
    """Stored messages, attempts and replies of every turn as ledger rows."""
    return _request_ledger(spark, sf_dir).select("request_id", *LEDGER_COLUMNS, F.col("cost_usd").cast("double").alias("cost_usd"))


@query
def request_ledger_costs(spark, sf_dir):
    """The same rows appended to a ledger, read back and summed."""
    path = shared_path(spark, "ledger")
    append_ledger(_request_ledger(spark, sf_dir), path)
    return read_ledger(spark, path).groupBy("provider", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").cast("double").alias("cost_usd"))


# --- attempts ------------------------------------------------------------------------------


@query
def first_success(spark, sf_dir):
    last = view(spark, sf_dir, "prices").agg(F.max("chain_pos")).first()[0]
    return A.request_outcomes(view(spark, sf_dir, "attempts"), last)


STREAK_COLUMNS = ["provider", "request_id", "chain_pos", "ts_s", "streak", "open_until_s", "made_while_open"]


def _streaks(spark, sf_dir):
    return A.failure_streaks(view(spark, sf_dir, "attempts").select("provider", *A.ORDER, "status"))


@query
def failure_streaks(spark, sf_dir):
    return _streaks(spark, sf_dir).select(*STREAK_COLUMNS)


@query
def open_intervals(spark, sf_dir):
    return A.open_intervals(_streaks(spark, sf_dir))


@query
def attempts_while_open(spark, sf_dir):
    return A.attempts_while_open(_streaks(spark, sf_dir))


@query
def provider_health(spark, sf_dir):
    attempts = view(spark, sf_dir, "attempts")
    as_of = attempts.agg(F.max("ts_s")).first()[0] + 1
    return A.provider_health(attempts, as_of, providers=view(spark, sf_dir, "prices"))


# --- quality -------------------------------------------------------------------------------


def _penalty(spark, sf_dir, name):
    return Q.with_penalties(view(spark, sf_dir, "probe_text")).select("doc_id", name)


@query
def quality_xml(spark, sf_dir):
    return _penalty(spark, sf_dir, "xml_hallucination")


@query
def quality_formatting(spark, sf_dir):
    return _penalty(spark, sf_dir, "formatting_violation")


@query
def quality_injection(spark, sf_dir):
    return _penalty(spark, sf_dir, "prompt_injection")


@query
def quality_coherence(spark, sf_dir):
    return _penalty(spark, sf_dir, "coherence")


@query
def quality_score(spark, sf_dir):
    return Q.score_texts(view(spark, sf_dir, "probe_text")).select("doc_id", *CHECK_COLUMNS)


@query
def quality_details(spark, sf_dir):
    scored = Q.score_texts(view(spark, sf_dir, "probe_text"), details=True)
    return scored.select(
        "doc_id", F.array_join("details", " | ").alias("details"), F.array_join("findings", " | ").alias("findings")
    )


# --- safety --------------------------------------------------------------------------------


@query
def safety_messages(spark, sf_dir):
    return S.safety_hits(C.flatten_messages(view(spark, sf_dir, "chat_messages"))).select(
        "request_id", "turn", "hit_no", "pattern"
    )


@query
def safety_verdicts(spark, sf_dir):
    verdicts = S.safety_verdicts(C.flatten_messages(view(spark, sf_dir, "chat_messages")))
    patterns = F.array_join(
        F.transform("blocked_patterns", lambda p: F.concat(p["pattern"], F.lit(" x"), p["hits"].cast("string"))), "; "
    )
    return verdicts.select("request_id", "safe", "hits", patterns.alias("blocked_patterns"))


@query
def scrubbed_text(spark, sf_dir):
    return S.scrub_texts(view(spark, sf_dir, "probe_text")).select("doc_id", "text", "changed")


@query
def secret_inventory(spark, sf_dir):
    return S.secret_inventory(view(spark, sf_dir, "probe_text"))


@query
def secret_counts(spark, sf_dir):
    return S.secret_counts(S.secret_inventory(view(spark, sf_dir, "probe_text")))


@query
def placeholder_keys(spark, sf_dir):
    return view(spark, sf_dir, "key_values").select("id", is_placeholder(F.col("value")).alias("placeholder"))


def _events(spark, sf_dir):
    return parse_payloads(view(spark, sf_dir, "hook_events"))


@query
def shell_gate(spark, sf_dir):
    return H.shell_commands(_events(spark, sf_dir)).select("event_id", "command", "matched", "blocked")


@query
def blocked_audit(spark, sf_dir):
    return S.blocked_audit(H.shell_commands(_events(spark, sf_dir))).select("event_id", "command", "tag", "text")


# --- messages and events -------------------------------------------------------------------


@query
def flatten_messages(spark, sf_dir):
    return C.flatten_messages(view(spark, sf_dir, "chat_messages"))


@query
def system_messages(spark, sf_dir):
    flat = C.flatten_messages(view(spark, sf_dir, "chat_messages"))
    return C.prepend_system(flat, view(spark, sf_dir, "system_prompts"))


@query
def canonical_responses(spark, sf_dir):
    return C.canonical_responses(view(spark, sf_dir, "responses")).select(
        "request_id", "turn", "message.id", "message.type", "message.role",
        F.col("message.content")[0]["text"].alias("text"), "message.model", "message.stop_reason",
        "message.usage.input_tokens", "message.usage.output_tokens",
        "tokens_in", "tokens_out", "passed", "scrubbed",
    )


@query
def payload_context(spark, sf_dir):
    return H.contexts_of(_events(spark, sf_dir), F.lit(True)).select("event_id", "context", "project", "session_id")


@query
def quarantined_payloads(spark, sf_dir):
    return quarantined(_events(spark, sf_dir)).select("event_id", "payload")


@query
def compaction_events(spark, sf_dir):
    return H.compaction_events(_events(spark, sf_dir)).select("event_id", "tool_name", "payload_bytes")


@query
def dispatch_audit(spark, sf_dir):
    """Compaction events in the audit log."""
    path = shared_path(spark, "audit")
    rows = H.dispatch_audit(H.compaction_events(_events(spark, sf_dir)), "compaction").select("event_id", "tool_name", "tag", "text")
    append_audit(rows.select("tag", "text"), path)
    logged = spark.read.parquet(path).groupBy("tag", "text").agg(F.count(F.lit(1)).alias("logged"))
    # Every row must be found in the log again.
    return rows.join(logged, ["tag", "text"], "left_semi").select("event_id", "tool_name", "tag", "text")


@query
def session_end_events(spark, sf_dir):
    return H.session_end_events(_events(spark, sf_dir)).select("event_id", "content", "payload_bytes")


# --- memories ------------------------------------------------------------------------------

ITEM_COLUMNS = ["run_id", "run_part", "category", "pos", "content", "importance", "subcategory"]


def _items(spark, sf_dir):
    return E.parsed_items(view(spark, sf_dir, "model_outputs"))


@query
def parsed_items(spark, sf_dir):
    return _items(spark, sf_dir).select(*ITEM_COLUMNS)


@query
def failed_outputs(spark, sf_dir):
    return E.failed_outputs(view(spark, sf_dir, "model_outputs")).select("run_id", "run_part", "category")


@query
def committed_memories(spark, sf_dir):
    return M.committed_memories(_items(spark, sf_dir)).select("commit_hash", *ITEM_COLUMNS)


@query
def committed_to_store(spark, sf_dir):
    """As committed_memories, against a store that already knows the text 'shared' as a fact."""
    items = _items(spark, sf_dir)
    store = M.with_key(
        items.filter((F.col("content") == "shared") & (F.col("category") == "fact"))
    ).select("commit_hash").distinct()
    return M.committed_memories(items, store).select("commit_hash", *ITEM_COLUMNS)


def _runs(spark, sf_dir):
    outputs, items = view(spark, sf_dir, "model_outputs"), _items(spark, sf_dir)
    return M.run_summary(outputs, items, M.committed_memories(items))


@query
def run_summary(spark, sf_dir):
    return _runs(spark, sf_dir)


@query
def recent_runs(spark, sf_dir):
    return M.recent_runs(_runs(spark, sf_dir), M.RUN_KEYS)


@query
def rule_facts(spark, sf_dir):
    return E.rule_facts(view(spark, sf_dir, "contexts"))


@query
def rule_sentences(spark, sf_dir):
    return E.rule_sentences(view(spark, sf_dir, "contexts"))


EXTRACT_PATTERNS = {
    "fact": r"https?://[A-Za-z0-9./?=]+|[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "decision": r"We [a-z]+ [^.!?\n]* because [^.!?\n]*",
    "skill": r"The gotcha[^.!?\n]*",
}


def pattern_extractor(category: str, context: str) -> str:
    """An extractor of the caller: what the category's pattern finds, as a model would return it."""
    found = re.findall(EXTRACT_PATTERNS[category], context)
    if category == "skill" and not found:
        raise ValueError("no skill found")
    return "Sure: " + json.dumps([{"text": text, "importance": 8} for text in found])


def _extracted(spark, sf_dir):
    contexts = view(spark, sf_dir, "contexts").withColumnRenamed("context_id", "run_id")
    return E.model_extraction(contexts, pattern_extractor).withColumn("run_part", F.lit(0))


@query
def model_extraction(spark, sf_dir):
    return E.parsed_items(_extracted(spark, sf_dir)).select(
        "run_id", "category", "pos", "content", "importance", "subcategory", "context_length"
    )


@query
def extraction_errors(spark, sf_dir):
    """What extractors failed at."""
    return _extracted(spark, sf_dir).filter("error is not null").select("run_id", "category", "error")


@query
def memory_stats(spark, sf_dir):
    return M.memory_stats(view(spark, sf_dir, "memories"))


@query
def top_projects(spark, sf_dir):
    return M.top_projects(view(spark, sf_dir, "memories"))


@query
def recent_memories(spark, sf_dir):
    return M.recent_memories(view(spark, sf_dir, "memories"), "created_s", "mem_id")


# --- search --------------------------------------------------------------------------------

HIT_COLUMNS = [
    "query_id", "mem_id", "category", "subcategory", "content", "importance", "project", "created_s", "access_count",
]


_STORED: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in listed))


def _stored(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[DataFrame, str], object]) -> str:
    """An index over the memories view: built once per application and state of the table's files, as a store keeps its own."""
    known = (spark.sparkContext.applicationId, kind, _files(spark, f"{sf_dir}/documents.parquet"))
    if known not in _STORED:
        path = shared_path(spark, kind)
        build(view(spark, sf_dir, "memories"), path)
        _STORED[known] = path
    return _STORED[known]


def stored_index(spark: SparkSession, sf_dir: str) -> R.MemoryIndex:
    return R.read_index(spark, _stored(spark, sf_dir, "index", R.build_index))


def stored_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.read_trigrams(spark, _stored(spark, sf_dir, "trigrams", G.build_trigrams))


@query
def index_build(spark, sf_dir):
    """The search index built anew, as figures of its blocks."""
    index = R.build_index(view(spark, sf_dir, "memories"))
    return index.blocks.groupBy("stem").agg(
        F.sum("n").alias("memories"), *[F.sum(F.col("n_by_column")[i]).alias(f"in_{name}") for i, name in enumerate(R.COLUMNS)],
        F.sum(F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e["f0"] + e["f1"] + e["f2"] + e["f3"])).alias("occurrences"))


def _search(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = R.search(view(spark, sf_dir, "memories"), query_table(spark, SEARCHES[name]), index=stored_index(spark, sf_dir))
        return hits.select(*HIT_COLUMNS, F.round("rank", 6).alias("rank"))

    run.__name__ = name
    return run


for _name in SEARCHES:
    query(_search(_name))


@query
def search_like(spark, sf_dir):
    hits = R.search_like(view(spark, sf_dir, "memories"), LIKE_TEXT, category="skill")
    return hits.select(*HIT_COLUMNS[1:], "rank")


@query
def term_frequencies(spark, sf_dir):
    return R.term_frequencies(R.analysed(view(spark, sf_dir, "memories")))


@query
def corpus_stats(spark, sf_dir):
    stats = R.corpus_stats(R.analysed(view(spark, sf_dir, "memories")))
    return stats.withColumn("avg_tokens", F.round(F.col("n_tokens") / F.col("n_docs"), 4))


@query
def vocabulary_stems(spark, sf_dir):
    return R.vocabulary_of(R.analysed(view(spark, sf_dir, "memories")))


@query
def access_touch(spark, sf_dir):
    """A search is logged; readers fold the log into the memories."""
    memories, log = view(spark, sf_dir, "memories"), shared_path(spark, "accesses")
    hits = R.ranked(stored_index(spark, sf_dir), query_table(spark, SEARCHES["search_any"]))
    log_access(hits, log)
    return with_access(memories, spark.read.parquet(log)).select("mem_id", "access_count")


@query
def search_store(spark, sf_dir):
    """Commit memories, which keeps the store's index current, then search the store."""
    out = shared_path(spark, "store")
    outputs = view(spark, sf_dir, "model_outputs")
    half = F.col("run_id") % 2 == 0
    for part in (outputs.filter(half), outputs.filter(~half)):
        commit_outputs(part, f"{out}/memories", f"{out}/runs", index_path=f"{out}/index")
    hits = R.search(
        read_memories(spark, f"{out}/memories"), query_table(spark, STORE_SEARCHES),
        index=R.read_index(spark, f"{out}/index"), key="commit_hash")
    return hits.select("query_id", "commit_hash", "category", "content", F.round("rank", 6).alias("rank"))


@query
def run_log(spark, sf_dir):
    """The runs of two calls over the same outputs; the second one logs nothing."""
    out = shared_path(spark, "store")
    for _ in range(2):
        commit_outputs(view(spark, sf_dir, "model_outputs"), f"{out}/memories", f"{out}/runs")
    runs = spark.read.schema(schemas.RUNS).parquet(f"{out}/runs")
    return runs.select("run_id", "context_length", "extracted", "committed")


@query
def search_fallback(spark, sf_dir):
    """R4 for the queries without tokens that match no index entry."""
    asked = query_table(spark, FALLBACK_SEARCHES)
    hits = R.search_like_all(view(spark, sf_dir, "memories"), R.fallback_queries(asked), grams=stored_trigrams(spark, sf_dir))
    return hits.select("query_id", *HIT_COLUMNS[1:], "rank")


@query
def search_routed(spark, sf_dir):
    """Ranked and substring queries together, each by what can answer it."""
    hits = R.search_routed(
        view(spark, sf_dir, "memories"), query_table(spark, ROUTED_SEARCHES), index=stored_index(spark, sf_dir), grams=stored_trigrams(spark, sf_dir))
    return hits.select(*HIT_COLUMNS, F.round("rank", 6).alias("rank"))


# --- streams -------------------------------------------------------------------------------
# Each query drains its stream into a fresh folder and returns what was written.


STREAM_BATCHES = 3
#: Rows of one arriving file. Rows of one time stand in few files of a table; this gives a batch tasks enough.
ARRIVING_ROWS = 10_000


def arriving(rows: DataFrame, order: str, path: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let the rows arrive in STREAM_BATCHES parts, in order of a numeric column.

    After each part the stream is started over the folder and drained; it goes on from its checkpoint.
    """
    first, last = rows.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - first) * STREAM_BATCHES / F.lit(max(last - first, 1))), F.lit(STREAM_BATCHES - 1))
    for number in range(STREAM_BATCHES):
        rows.filter(part == number).write.mode("append").option("maxRecordsPerFile", ARRIVING_ROWS).parquet(path)
        start(rows.sparkSession.readStream.schema(rows.schema).parquet(path)).awaitTermination()


def view_arriving(
    spark: SparkSession, sf_dir: str, table: str, name: str, order: str, start: Callable[[DataFrame], StreamingQuery]
) -> None:
    """The same for a view over a table."""

    def over_view(source: DataFrame) -> StreamingQuery:
        source.createOrReplaceTempView(f"{table}_stream")
        return start(spark.sql(VIEWS[name].replace(f"FROM {table}", f"FROM {table}_stream")))

    arriving(spark.read.parquet(f"{sf_dir}/{table}.parquet"), order, shared_path(spark, "stream-source"), over_view)


@query
def stream_gate(spark, sf_dir):
    out = shared_path(spark, "stream")
    view_arriving(spark, sf_dir, "documents", "probe_text", "doc_id", lambda texts: T.append_stream(
        T.gated_texts(texts), f"{out}/data", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/data").select("doc_id", "text", "score", "passed", "changed")


@query
def stream_commands(spark, sf_dir):
    out = shared_path(spark, "stream")
    view_arriving(spark, sf_dir, "events", "hook_events", "event_id", lambda events: T.append_stream(
        T.command_alerts(parse_payloads(events)), f"{out}/data", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/data").select("event_id", "command", "tag", "text")


@query
def stream_rolling_cost(spark, sf_dir):
    out, prices = shared_path(spark, "stream"), view(spark, sf_dir, "prices")
    view_arriving(spark, sf_dir, "events", "ledger_raw", "event_id", lambda ledger: T.slide_stream(
        T.cost_slides(P.priced(ledger, prices)), f"{out}/data", f"{out}/checkpoint"))
    rows = T.windows_of(spark.read.parquet(f"{out}/data"))
    return rows.select(
        F.unix_seconds("start").alias("start_s"), "provider", "model", "requests", "tokens_in", "tokens_out",
        F.col("cost_usd").cast("double").alias("cost_usd"),
    )


def arriving_together(sources: dict[str, tuple[DataFrame, str, str]], path: str, start: Callable[..., StreamingQuery]) -> None:
    """Let several tables arrive in STREAM_BATCHES parts of the same times, and then one heartbeat in each.

    sources: name -> (rows, event time column, column of the second at which a row is seen). Rows are written
    once, so that no part computes them again.
    """
    sources = {name: (stage(rows, name), at, seen) for name, (rows, at, seen) in sources.items()}
    bounds = [rows.agg(F.min(seen), F.max(seen)).first() for rows, _, seen in sources.values()]
    first, last = min(low for low, _ in bounds), max(high for _, high in bounds)
    for number in range(STREAM_BATCHES + 1):
        streams = []
        for name, (rows, at, seen) in sources.items():
            spark = rows.sparkSession
            part = F.least(F.floor((F.col(seen) - first) * STREAM_BATCHES / F.lit(max(last - first, 1))), F.lit(STREAM_BATCHES - 1))
            if number < STREAM_BATCHES:
                arrived = rows.filter(part == number)
            else:
                beat = spark.range(1).select(F.lit(N.HEARTBEAT).alias("request_id"), F.timestamp_seconds(F.lit(last + 10 * N.REPLY_SECONDS)).alias(at))
                arrived = rows.limit(0).unionByName(beat, allowMissingColumns=True)
            arrived.write.mode("append").option("maxRecordsPerFile", ARRIVING_ROWS).parquet(f"{path}/{name}")
            streams.append(spark.readStream.schema(rows.schema).parquet(f"{path}/{name}"))
        start(*streams).awaitTermination()


@query
def stream_ledger(spark, sf_dir):
    """S4 as a stream: requests, attempts and replies joined as they arrive; rows up to 400 seconds late."""
    out, providers = shared_path(spark, "stream"), default_providers(spark)
    bodies = view(spark, sf_dir, "turn_messages").select("request_id", F.array("content").alias("messages"))
    late = F.pmod(F.xxhash64("request_id"), F.lit(5)) * 100
    requests = _timed(spark, sf_dir, "turn_requests", "asked").drop("conv_id", "turn", "number").join(bodies, "request_id")
    sources = {
        "requests": (requests.withColumn("seen_s", F.col("asked_s") + late), "asked_at", "seen_s"),
        "attempts": (_timed(spark, sf_dir, "turn_attempts", "tried").withColumn("seen_s", F.col("tried_s") + late), "tried_at", "seen_s"),
        "replies": (_timed(spark, sf_dir, "turn_replies", "replied").withColumn("seen_s", F.col("replied_s")), "replied_at", "seen_s"),
    }
    arriving_together(sources, f"{out}/source", lambda asked, tried, replied: T.ledger_stream(
        N.ledger_facts(asked, tried, replied, providers, _last_position()), f"{out}/ledger", f"{out}/checkpoint"))
    return read_ledger(spark, f"{out}/ledger").select(
        F.col("id").alias("request_id"), *LEDGER_COLUMNS, F.col("cost_usd").cast("double").alias("cost_usd"))


@query
def stream_breaker(spark, sf_dir):
    """The attempts view needs a window, which no stream offers: its rows are written, then streamed."""
    out = shared_path(spark, "stream")
    arriving(view(spark, sf_dir, "attempts"), "ts_s", f"{out}/log", lambda log: T.breaker_stream(
        log, f"{out}/data", f"{out}/state", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/data").select(*STREAK_COLUMNS)


@query
def stream_memories(spark, sf_dir):
    out = shared_path(spark, "stream")
    view_arriving(spark, sf_dir, "events", "hook_events", "event_id", lambda events: T.memory_stream(
        parse_payloads(events), pattern_extractor, f"{out}/store", f"{out}/checkpoint"))
    return read_memories(spark, f"{out}/store").select("commit_hash", "category", "subcategory", "content", "importance")


@query
def stream_counters(spark, sf_dir):
    out = shared_path(spark, "stream")
    view_arriving(spark, sf_dir, "events", "ledger_raw", "event_id", lambda ledger: T.snapshot_stream(
        T.gate_counters(ledger), f"{out}/data", f"{out}/checkpoint"))
    return T.newest_snapshot(spark, f"{out}/data").select("outcome", "requests")
