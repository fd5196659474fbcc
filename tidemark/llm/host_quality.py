"""Operator 10: quality rules per document, and verdicts per host from shrunken failure rates.

Rule figures of a document come from one Arrow pass over its words. Hosts are judged by how many
of their documents fail a base rule: counts per host meet in a pre-aggregated sum; a beta prior is
fitted to all hosts' rates by moments; a host's rate is shrunk towards the prior mean, more so the
fewer documents it has; hosts with a shrunken rate of at least `host_limit` are rejected, and the
verdict is joined back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.session import stage

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host whose shrunken rate of failing documents reaches this is rejected as a whole.
HOST_LIMIT = 0.6
#: Texts are read in blocks of this many bytes; their words and hashes take some fifteen times that.
TEXT_BYTES = 4 << 20
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged, without an integer per byte."""
    out, filled = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets) > 0
    if filled.any():
        out[filled] = np.add.reduceat(flags, offsets[:-1][filled], dtype=np.int64)
    return out


def _repeat_words(hashes: np.ndarray) -> int:
    """Words inside windows of 8 words that occur at least twice in this text."""
    if len(hashes) <= WINDOW_WORDS:
        return 0
    windows = textkit.run_hashes(hashes, WINDOW_WORDS)
    order = np.argsort(windows)
    equal = windows[order][1:] == windows[order][:-1]
    if not equal.any():
        return 0
    again = np.zeros(len(windows), np.int64)
    again[order[1:][equal]] = 1
    again[order[:-1][equal]] = 1
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[: len(windows)] += again
    edges[WINDOW_WORDS:] -= again
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _duplicate_lines(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    count = np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets))
    result = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(count):
        lo, hi = offsets[i], offsets[i + 1]
        own = data[lo:hi].tobytes().split(b"\n")
        if len(set(own)) == len(own):
            continue
        seen: set[bytes] = set()
        for line in own:
            if line in seen:
                result[i] += bool(line.strip(b" \t\n\x0b\x0c\r"))
            seen.add(line)
    return result


def figures_of(texts: pa.Array) -> list[np.ndarray]:
    """The FIGURES of each text."""
    data, offsets = textkit.utf8(texts)
    starts, ends, ranges = textkit.word_spans(data, offsets)
    begins = (data & 0xC0) != 0x80
    inside = ~textkit.WHITE[data]
    codes, dictionary = textkit.word_codes(data, starts, ends)
    hashes = textkit.word_hashes(dictionary)[codes] if len(codes) else np.empty(0, np.uint64)
    repeats = np.fromiter((_repeat_words(hashes[a:b]) for a, b in zip(ranges[:-1], ranges[1:], strict=True)), np.int64, len(texts))
    return [
        np.diff(ranges), _per_text(begins & inside, offsets), _per_text(_SYMBOL[data], offsets),
        _duplicate_lines(texts, data, offsets), repeats,
    ]


def rule_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, then the FIGURES (long).

    A null or empty text has zeros. One row out per row in; clashing columns of the input with the
    names of figures are replaced.
    """
    others = [c for c in docs.columns if c != text and c not in FIGURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in textkit.blocks(batches, text, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays(
                [block.column(c) for c in others] + [pa.array(x, pa.int64()) for x in figures_of(block.column(text))],
                others + FIGURES)

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"{c} long" for c in FIGURES])
    return docs.select(*others, text).mapInArrow(run, schema)


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 percent of the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per non-null host: n_docs, n_failed, shrunken rate, host_rejected.

    Needs a boolean column base_failed. The beta prior has the mean and the spread of all hosts'
    rates by the method of moments (each host weighs by its documents; the binomial part of the
    spread is taken off). Without spread beyond chance the prior is as heavy as all documents of
    an average host, so that no host moves far from the mean.
    """
    hosts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, x = F.col("n_docs"), F.col("n_failed")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n1"), F.sum(n.cast("double") * n).alias("n2"),
        F.sum(x).alias("x1"), F.sum(x.cast("double") * x / n).alias("xx"))
    mean = F.col("x1") / F.col("n1")
    # Between-host variance of the rates (analysis of variance for proportions).
    within = (F.col("x1") - F.col("xx")) / F.greatest(F.col("n1") - F.col("k"), F.lit(1))
    between = (F.col("xx") - F.col("n1") * mean * mean) / F.greatest(F.col("k") - 1, F.lit(1))
    size = (F.col("n1") - F.col("n2") / F.col("n1")) / F.greatest(F.col("k") - 1, F.lit(1))
    variance = F.when(size > 0, F.greatest((between - within) / size, F.lit(0.0))).otherwise(F.lit(0.0))
    weight = F.when(variance > 0, F.greatest(mean * (1 - mean) / variance - 1, F.lit(1.0))).otherwise(F.col("n1") / F.col("k"))
    prior = sums.select(F.struct(mean.alias("mean"), weight.alias("weight"))).scalar()
    rate = (x + prior["mean"] * prior["weight"]) / (n + prior["weight"])
    return hosts.select(host, "n_docs", "n_failed", rate.alias("host_rate"), (rate >= limit).alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """rule_figures plus base_failed, host_rate (null without a host) and kept.

    kept is false if base_failed or the host is rejected. A document without a host is judged by
    its own rules only. Repeated rows count as often as they come. The figures are computed once
    for the counts and once for the join, so they are written to the shared folder in between.
    """
    judged = stage(rule_figures(docs, text).withColumn("base_failed", base_failed()), "quality")
    # Written first: the planner then knows their size, and few hosts need no shuffle of documents.
    verdicts = stage(host_verdicts(judged, host, limit).select(F.col(host).alias("_host"), "host_rate", "host_rejected"), "hosts")
    joined = judged.drop("host_rate", "host_rejected", "kept").join(verdicts, F.col(host) == F.col("_host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).drop("_host", "host_rejected")


def kept_documents(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that `judge` keeps, as they are; row by row, so keys may repeat or be null.

    The texts are not shuffled: each task drops the rows that fail, and the rejected hosts (written
    first, so that their size is known) are met by the remaining rows.
    """
    counts = stage(rule_figures(docs.select(host, text), text).select(host, base_failed().alias("base_failed")), "quality")
    rejected = stage(host_verdicts(counts, host, limit).where("host_rejected").select(host), "hosts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in textkit.blocks(batches, text, TEXT_BYTES):
            n_words, _, _, _, repeats = figures_of(block.column(text))
            yield block.filter(pa.array(~((n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words))))

    return docs.mapInArrow(run, docs.schema).join(rejected, host, "left_anti").select(*docs.columns)


ORACLE = """
with d as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), lines as (
  select doc_id, line, row_number() over (partition by doc_id, line order by i) as k
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d)
), dups as (
  select doc_id, count(*) as n_dup_lines from lines where k > 1 and regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id
), windows as (
  select doc_id, i, array_to_string(ws[i + 1 : i + 8], ' ') as body from (select doc_id, ws, unnest(range(len(ws) - 7)) as i from d where len(ws) > 7)
), again as (
  select doc_id, i, count(*) over (partition by doc_id, body) as n from windows
), repeats as (
  select doc_id, count(distinct i + j) as n_repeat_words from again, range(8) r(j) where n > 1 group by doc_id
), figures as (
  select d.doc_id, d.source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join dups using (doc_id) left join repeats using (doc_id)
), judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from figures
), hosts as (
  select source, count(*)::double as n, count(*) filter (base_failed)::double as x from judged where source is not null group by source
), sums as (
  select count(*)::double as k, sum(n) as n1, sum(n * n) as n2, sum(x) as x1, sum(x * x / n) as xx from hosts
), spread as (
  select *, x1 / n1 as mean, (n1 - n2 / n1) / greatest(k - 1, 1) as size,
    (xx - x1 * x1 / n1) / greatest(k - 1, 1) - (x1 - xx) / greatest(n1 - k, 1) as surplus from sums
), prior as (
  select mean, case when size > 0 and surplus > 0 then greatest(mean * (1 - mean) / (surplus / size) - 1, 1) else n1 / k end as weight from spread
), rates as (
  select source, (x + mean * weight) / (n + weight) as rate from hosts, prior
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) as host_rate,
  not base_failed and coalesce(rate, 0) < 0.6 as kept
from judged left join rates using (source)
"""
