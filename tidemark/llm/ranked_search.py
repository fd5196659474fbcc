"""Operator 12: ranked lexical search, term at a time with limited accumulators.

The index holds every document: one row per block of rows (about `textkit.BLOCK_BYTES` of text) with
the block's terms, each term's postings (document in the block, occurrences) and the documents' lengths.
Postings never leave their block and are never shuffled; what is added up over all blocks are the
number of documents, of terms, and the document frequencies of the queries' terms.

Each block answers a batch of queries of bounded size. A query's terms are taken rarest first. A
term adds its part to its documents' accumulators; once what the remaining terms can add at most
(the sum of their greatest parts in the block) is below the k-th best score so far, no new
accumulator is made, and the remaining terms update only the survivors, exactly, by binary search
in the postings. The k-th best score carries from block to block of a task. The best k of every task
meet in two steps, salted first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.session import stage

TOP = 20
#: Queries are answered in batches of at most about this many bytes of query text.
QUERY_BYTES = 8 << 20
SALTS = 64

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
APART = np.ones(256, bool)
APART[0x30:0x3A] = APART[0x41:0x5B] = APART[0x61:0x7B] = APART[0x80:] = False
_NEWLINE = 10


def _block_row(block: pa.RecordBatch) -> list:
    """n_docs, n_terms, documents' ids and lengths, terms, frequencies, postings of one block."""
    order = pc.sort_indices(block.column("doc_id"), null_placement="at_start")
    block = block.take(order)
    data, offsets = textkit.utf8(block.column("text"))
    data = textkit.lowered(data)
    starts, ends, ranges = textkit.word_spans(data, offsets, APART)
    lengths = np.diff(ranges)
    codes, vocabulary = textkit.word_codes(data, starts, ends, APART)
    pairs = codes.astype(np.int64) * len(lengths) + np.repeat(np.arange(len(lengths)), lengths)
    pairs.sort()
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(pairs)))
    pairs = pairs[first]
    frequencies = np.bincount(pairs // max(len(lengths), 1), minlength=len(vocabulary))
    return [
        int((lengths > 0).sum()), int(lengths.sum()), block.column("doc_id"), lengths.astype(np.int32).tobytes(),
        _joined(vocabulary), frequencies.astype(np.int32).tobytes(), (pairs % max(len(lengths), 1)).astype(np.int32).tobytes(),
        times.astype(np.int32).tobytes(),
    ]


def _joined(vocabulary: pa.Array) -> bytes:
    """Terms end to end, a newline (which no term holds) after each."""
    return b"".join(pc.binary_join_element_wise(vocabulary.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary())).to_pylist())


def _terms(joined: bytes) -> pa.Array:
    data = np.frombuffer(joined, np.uint8)
    stops = np.flatnonzero(data == _NEWLINE)
    return textkit.binary_array(data[data != _NEWLINE], np.append(0, stops - np.arange(len(stops))))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = textkit.BLOCK_BYTES) -> DataFrame:
    """The stored index of all rows of docs: one row per block.

    A null text has no terms. Rows with equal or null keys are documents of their own. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in textkit.blocks(batches, "text", block_bytes):
            n_docs, n_terms, ids, *parts = _block_row(block)
            listed = pa.LargeListArray.from_arrays(pa.array([0, len(ids)], pa.int64()), ids).cast(pa.list_(ids.type))
            yield pa.RecordBatch.from_arrays(
                [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), listed, *(pa.array([p], pa.large_binary()).cast(pa.binary()) for p in parts)],
                names=["n_docs", "n_terms", "ids", "lengths", "terms", "frequencies", "docs", "times"])

    schema = f"n_docs long, n_terms long, ids array<{kind}>, lengths binary, terms binary, frequencies binary, docs binary, times binary"
    return stage(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema), "search-blocks")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in textkit.blocks(batches, "text"):
        data, offsets = textkit.utf8(block.column("text"))
        data = textkit.lowered(data)
        starts, ends, ranges = textkit.word_spans(data, offsets, APART)
        words = textkit.binary_array(data[~APART[data]], np.append(0, np.cumsum(ends - starts)))
        lists = pa.LargeListArray.from_arrays(pa.array(ranges, pa.int64()), words).cast(pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([block.column("item_id"), lists], names=["item_id", "terms"])


class _Queries:
    """A batch of queries: their distinct terms and, per query, pairs (term number, repeats)."""

    def __init__(self, lists: list[list[bytes]]):
        numbers: dict[bytes, int] = {}
        self.parts: list[dict[int, int]] = []
        for terms in lists:
            part: dict[int, int] = {}
            for term in terms:
                n = numbers.setdefault(bytes(term), len(numbers))
                part[n] = part.get(n, 0) + 1
            self.parts.append(part)
        self.terms = list(numbers)


def _found(row: dict, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which wanted terms the block has, and the start and length of their postings."""
    frequencies = np.frombuffer(row["frequencies"], np.int32).astype(np.int64)
    numbers = pc.index_in(_terms(row["terms"]), value_set=wanted.cast(pa.large_binary()))
    at = np.flatnonzero(pc.is_valid(numbers).to_numpy(zero_copy_only=False))
    begins = np.append(0, np.cumsum(frequencies))
    return pc.fill_null(numbers, 0).to_numpy(zero_copy_only=False)[at], begins[at], frequencies[at]


def _frequencies(index: DataFrame, wanted) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(wanted.value, pa.binary())
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                numbers, _, counts = _found(batch.slice(i, 1).to_pylist()[0], terms)
                total[numbers] += counts
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    return index.select("terms", "frequencies").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class _Block:
    """A block's postings of the batch's terms, with each posting's part of a score."""

    def __init__(self, row: dict, wanted: pa.Array, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        if 25 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
            penalty = 75 + 25 * lengths * n_docs // max(n_terms, 1)
        else:
            penalty = np.array([75 + 25 * int(n) * n_docs // n_terms for n in lengths], np.int64)
        docs, times = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["times"], np.int32)
        self.postings: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for number, begin, count in zip(*(a.tolist() for a in _found(row, wanted))):
            here, tf = docs[begin : begin + count], times[begin : begin + count].astype(np.int64)
            parts = weights[number] * (1_000_000_000 * tf // (1000 * tf + 12 * penalty[here]))
            self.postings[number] = here, parts, int(parts.max())

    def best(self, query: dict[int, int], weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document) of all documents that may be among the best k, scores exact; floor is a k-th best score known."""
        terms = sorted((t for t in query if t in self.postings and weights[t] > 0), key=lambda t: (-weights[t], t))
        bounds = [self.postings[t][2] * query[t] for t in terms]
        left = sum(bounds)
        sums = np.zeros(len(self.ids), np.int64)
        for step, term in enumerate(terms):
            if left < floor:
                return self._survivors(sums, terms[step:], query, left, floor)
            docs, parts, _ = self.postings[term]
            sums[docs] += parts * query[term]
            left -= bounds[step]
            if len(sums) >= k:
                floor = max(floor, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
        return self._pairs(sums, np.flatnonzero(sums), floor)

    def _survivors(self, sums: np.ndarray, terms: list[int], query: dict[int, int], left: int, floor: int) -> list[tuple[int, int]]:
        docs = np.flatnonzero((sums > 0) & (sums + left >= floor))
        scores = sums[docs]
        for term in terms:
            if not len(docs):
                break
            here, parts, _ = self.postings[term]
            at = np.minimum(np.searchsorted(here, docs), len(here) - 1)
            scores += np.where(here[at] == docs, parts[at], 0) * query[term]
        sums[docs] = scores
        return self._pairs(sums, docs, floor)

    @staticmethod
    def _pairs(sums: np.ndarray, docs: np.ndarray, floor: int) -> list[tuple[int, int]]:
        docs = docs[sums[docs] >= max(floor, 1)]
        return list(zip(sums[docs].tolist(), docs.tolist()))


def _order(entry: tuple[int, object]) -> tuple:
    score, doc = entry
    return (-score, doc is not None, doc if doc is not None else 0)


def _answers(index: DataFrame, shared, kind: str, k: int) -> DataFrame:
    """(query, doc_id, score): the best k per query of each task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, parts, weights, n_docs, n_terms = shared.value
        wanted = pa.array(terms, pa.binary())
        best: list[list[tuple[int, object]]] = [[] for _ in parts]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                block = _Block(batch.slice(i, 1).to_pylist()[0], wanted, weights, n_docs, n_terms)
                for query, part in enumerate(parts):
                    kept = best[query]
                    found = block.best(part, weights, k, kept[-1][0] if len(kept) == k else 0)
                    if found:
                        # Documents of a block are in order of id, so equal scores are too.
                        found = sorted(found, key=lambda pair: (-pair[0], pair[1]))[:k]
                        best[query] = sorted(kept + [(score, block.ids[doc]) for score, doc in found], key=_order)[:k]
        rows = [(query, doc, score) for query, kept in enumerate(best) for score, doc in kept]
        if rows:
            queries, docs, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(docs, id_type), pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    return index.select("ids", "lengths", "terms", "frequencies", "docs", "times").mapInArrow(run, f"query long, doc_id {kind}, score long")


def search(index: DataFrame, queries: DataFrame, k: int = TOP, key: str = "item_id", text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents with a score above 0.

    A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document's score is the sum over the query's
    terms, repeats included, of w * (1e9 tf div (1000 tf + 12 m)), m = 75 + (25 n N) div L, over all
    N documents that have terms and all their L terms. Equal scores rank by ascending doc_id, a null one first. A query
    row without terms has no rows. Rows with equal keys are queries of their own, each with ranks
    from 1. An empty table of documents or queries gives no rows.
    """
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    item = queries.schema[key].dataType.simpleString()
    parsed = stage(
        queries.select(queries[key].alias("item_id"), queries[text].alias("text"))
        .mapInArrow(_query_terms, f"item_id {item}, terms array<binary>").where(F.size("terms") > 0)
        .withColumn("size", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8))
        .withColumn("number", F.monotonically_increasing_id()), "search-queries")
    n_docs, n_terms = (int(n or 0) for n in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    n_batches = max(1, math.ceil((parsed.agg(F.sum("size")).first()[0] or 0) / query_bytes))
    answers = None
    for b in range(n_batches):
        rows = parsed.where(F.pmod(F.xxhash64("number"), F.lit(n_batches)) == b).select("number", "terms").collect()
        batch = _Queries([row["terms"] for row in rows])
        counts = np.zeros(len(batch.terms), np.int64)
        for term, df in _frequencies(index, spark.sparkContext.broadcast(batch.terms)).collect():
            counts[term] = df
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in counts.tolist()], np.int64)
        shared = spark.sparkContext.broadcast((batch.terms, batch.parts, weights, n_docs, n_terms))
        numbers = spark.sparkContext.broadcast([row["number"] for row in rows])
        found = _numbered(_answers(index, shared, kind, k), numbers, kind)
        answers = found if answers is None else answers.union(found)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    salted = Window.partitionBy("number", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).orderBy(*order)
    first = answers.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= k).drop("place")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(parsed.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def _numbered(answers: DataFrame, numbers, kind: str) -> DataFrame:
    """Query places of a batch replaced by the queries' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(numbers.value, pa.int64())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([table.take(batch.column("query")), batch.column("doc_id"), batch.column("score")], names=["number", "doc_id", "score"])

    return answers.mapInArrow(run, f"number long, doc_id {kind}, score long")


ORACLE = """
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM (SELECT row_number() OVER () AS row, * FROM documents)
), tf AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM lengths),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM benchmark
), scores AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (row), totals
  GROUP BY item_id, row
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
