"""Operator 6: toxicity from the nearest labelled examples by TF-IDF cosine over a selected vocabulary.

1. Examples: a bounded sample of the labelled training rows, EXAMPLES per label (those with the
   smallest hash of their id). Rows with crc32(doc_id as text) mod 5 = 0 are never examples.
2. Vocabulary: at most TERMS terms that nearly only one label has among the examples (chi-square
   and purity). Terms are runs of letters and digits, A-Z lower-cased, and the beginnings of such
   words (BEGINNING characters and a star), which inflected and compound forms share.
3. One pass over all whole texts counts these terms per document; document frequencies cover all
   documents. Weights are (1 + log tf) * log((1 + N) / (1 + df)), vectors have length one.
4. The index holds the examples in blocks of BLOCK; a term's posting list has one maximum per block.
   A document's products with the maxima bound all cosines of a block; blocks are scored
   exactly in order of their bounds, and skipped once the bound is below the document's K-th best.
5. The K nearest vote with their squared cosine; a logistic curve fitted on the examples' own votes
   (each without itself, weighted to the labels' shares among all training rows) calibrates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.session import stage

EXAMPLES = 2048
TERMS = 512
#: A term of the vocabulary has this chi-square (very many terms are tried), occurs in so many examples, and so much
#: of its occurrence is within one label when both labels are given equal weight.
MIN_CHI2 = 30.0
MIN_EXAMPLES = 3
MIN_PURITY = 0.95
BEGINNING = 5
NEAREST = 15
BLOCK = 64
FOLDS = 5
#: Weight of the labels' overall share in a vote, in units of one identical neighbour.
PRIOR_WEIGHT = 0.2

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def held_out(key: Column) -> Column:
    """True for the documents that labels are never learned from; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def _terms(texts: pa.Array) -> tuple[np.ndarray, list[str], list[str | None], np.ndarray]:
    """Word numbers of all texts end to end, the distinct words and their beginnings, each text's range."""
    data, offsets = textkit.utf8(texts)
    data = textkit.lowered(data)
    starts, ends, ranges = textkit.word_spans(data, offsets, _APART)
    codes, dictionary = textkit.word_codes(data, starts, ends, _APART)
    words = dictionary.cast(pa.large_string()).to_pylist()
    return codes, words, [w[:BEGINNING] + "*" if len(w) > BEGINNING else None for w in words], ranges


def _distinct_terms(docs: DataFrame) -> DataFrame:
    """(toxic, term): the distinct terms of each example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in textkit.blocks(batches, "text"):
            codes, words, begun, ranges = _terms(block.column("text"))
            for i, (a, b) in enumerate(zip(ranges[:-1], ranges[1:], strict=True)):
                numbers = np.unique(codes[a:b])
                own = sorted({words[n] for n in numbers} | {begun[n] for n in numbers if begun[n]})
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(block.column("toxic")[i], len(own)), pa.array(own, pa.string())], ["toxic", "term"])

    return docs.select("toxic", "text").mapInArrow(run, "toxic int, term string")


def _term_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per row: doc_id, terms array<int> (numbers in the vocabulary), counts array<int>."""
    number = {word: i for i, word in enumerate(vocabulary)}
    width = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in textkit.blocks(batches, "text"):
            codes, words, begun, ranges = _terms(block.column("text"))
            row = np.repeat(np.arange(len(block)), np.diff(ranges))
            cells = []
            for names in (words, begun):
                known = np.fromiter((number.get(w, -1) for w in names), np.int64, len(names))
                term = known[codes] if len(codes) else np.empty(0, np.int64)
                hit = term >= 0
                cells.append(row[hit] * width + term[hit])
            cell, count = np.unique(np.concatenate(cells), return_counts=True)
            offsets = pa.array(np.searchsorted(cell, np.arange(len(block) + 1) * width), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(cell % width, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))], ["doc_id", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, terms array<int>, counts array<int>")


def _document_frequencies(counted: DataFrame, width: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=width)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["t", "n"])

    frequency = np.zeros(width)
    if width:
        for row in counted.select("terms").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
            frequency[row["t"]] = row["n"]  # at most one row per term of the vocabulary
    return frequency


def _vectors(terms: list, counts: list, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors, dense over the vocabulary; zero for a row without terms."""
    out = np.zeros((len(terms), len(idf)))
    for i, (t, c) in enumerate(zip(terms, counts, strict=True)):
        out[i, t] = 1 + np.log(np.asarray(c, float))
    out *= idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


@dataclass
class BlockMaxIndex:
    """Labelled unit vectors in blocks, with each term's maximum per block."""

    ids: list
    labels: np.ndarray
    vectors: np.ndarray

    def __post_init__(self) -> None:
        # Alike examples share a block, which makes bounds tight: by heaviest term, then label.
        heaviest = self.vectors.argmax(axis=1) if self.vectors.size else np.zeros(len(self.ids), int)
        order = np.lexsort((self.labels, heaviest))
        self.ids = [self.ids[i] for i in order]
        self.labels, self.vectors = self.labels[order], self.vectors[order]
        starts = range(0, len(self.ids), BLOCK)
        self.blocks = [slice(s, min(s + BLOCK, len(self.ids))) for s in starts]
        self.maxima = np.stack([self.vectors[b].max(axis=0) for b in self.blocks]) if self.ids else np.zeros((0, self.vectors.shape[1]))

    def nearest(self, queries: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples of each query; -1 where fewer have a cosine > 0.

        Equal cosines go to the smaller place. skip: for each query an example to leave out.
        """
        n = len(queries)
        places, best = np.full((n, k), -1), np.zeros((n, k))
        if not self.ids:
            return places, best
        bound = queries @ self.maxima.T
        order = np.argsort(-bound, axis=1, kind="stable")
        for turn in range(len(self.blocks)):
            at = order[:, turn]
            value = bound[np.arange(n), at]
            open_ = (value > 0) & (value * (1 + 1e-12) >= best[:, -1])
            if not open_.any():
                break
            for b in np.unique(at[open_]):
                rows = np.flatnonzero(open_ & (at == b))
                block = self.blocks[b]
                cosine = queries[rows] @ self.vectors[block].T
                if skip is not None:
                    cosine[skip[rows][:, None] == np.arange(block.start, block.stop)] = 0
                both = np.concatenate([best[rows], cosine], axis=1)
                where = np.concatenate([places[rows], np.tile(np.arange(block.start, block.stop), (len(rows), 1))], axis=1)
                where[both <= 0] = -1
                pick = np.lexsort((np.where(where < 0, len(self.ids), where), -both), axis=1)[:, :k]
                best[rows] = np.take_along_axis(np.maximum(both, 0), pick, axis=1)
                places[rows] = np.take_along_axis(where, pick, axis=1)
        return places, best

    def votes(self, places: np.ndarray, cosines: np.ndarray, share: float) -> np.ndarray:
        weight = np.where(places >= 0, cosines**2, 0)
        label = self.labels[np.maximum(places, 0)] if len(self.labels) else np.zeros(places.shape)
        return ((weight * label).sum(axis=1) + PRIOR_WEIGHT * share) / (weight.sum(axis=1) + PRIOR_WEIGHT)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps with a small ridge."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - 1e-3 * beta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _examples(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, float]:
    """(doc_id, toxic, text) of the sample, and the share of label 1 among all training rows."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    # A key that the documents lack would waste its place in the sample.
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for label in (0, 1)]
    chosen = parts[0].union(parts[1])
    # The sample has at most 2 * per_label rows.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return stage(texts, "examples"), share


def _vocabulary(examples: DataFrame, terms: int) -> list[str]:
    n = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    pos, neg, n1, n0 = F.col("pos"), F.col("neg"), F.lit(float(n[1])), F.lit(float(n[0]))
    cross = pos * (n0 - neg) - neg * (n1 - pos)
    chi2 = (n0 + n1) * cross * cross / (n1 * n0 * (pos + neg) * F.greatest(n0 + n1 - pos - neg, F.lit(1.0)))
    purity = F.greatest(pos / n1, neg / n0) / (pos / n1 + neg / n0)
    counted = _distinct_terms(examples).groupBy("term").agg(
        F.sum("toxic").cast("double").alias("pos"), F.sum(1 - F.col("toxic")).cast("double").alias("neg"))
    best = counted.where(pos + neg >= MIN_EXAMPLES).where((chi2 >= MIN_CHI2) & (purity >= MIN_PURITY)).orderBy(chi2.desc(), "term").limit(terms)
    return [r["term"] for r in best.select("term").collect()]


def score(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES, terms: int = TERMS, nearest: int = NEAREST) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted, neighbours.

    docs has doc_id and text, labels has doc_id and toxic (0 or 1; other labels are ignored). A text
    that has no term of the vocabulary (also empty or null) has no neighbours and gets the score of
    the labels' overall share. neighbours: doc_id, toxic and cosine of the nearest examples as
    evidence, nearest first. Without examples of both labels every score is the share. Repeated rows
    come out as often as they go in.
    """
    examples, share = _examples(docs, labels, per_label)
    vocabulary = _vocabulary(examples, terms)
    counted = stage(_term_counts(docs, vocabulary), "term-counts")
    idf = np.log((1 + counted.count()) / (1 + _document_frequencies(counted, len(vocabulary))))
    sample = _term_counts(examples, vocabulary).join(examples.select("doc_id", "toxic"), "doc_id").orderBy("doc_id").collect() if vocabulary else []
    index = BlockMaxIndex([r["doc_id"] for r in sample], np.array([r["toxic"] for r in sample], float), _vectors([r["terms"] for r in sample], [r["counts"] for r in sample], idf))
    slope, offset = _curve(index, share, nearest)
    shared = docs.sparkSession.sparkContext.broadcast((index, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        ids = np.array(own.ids + [-1])
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                queries = _vectors(part.column("terms").to_pylist(), part.column("counts").to_pylist(), weights)
                places, cosines = own.nearest(queries, nearest)
                value = 1 / (1 + np.exp(-np.clip(slope * own.votes(places, cosines, share) + offset, -30, 30)))
                found = places >= 0
                offsets = pa.array(np.append(0, np.cumsum(found.sum(axis=1))), pa.int32())
                flat = places[found]
                evidence = pa.StructArray.from_arrays(
                    [pa.array(ids[flat], kind_of_id), pa.array(own.labels[flat].astype(np.int32)), pa.array(cosines[found])], ["doc_id", "toxic", "cosine"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(value), pa.ListArray.from_arrays(offsets, evidence)], ["doc_id", "score", "neighbours"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kind_of_id = pa.int64() if kind == "bigint" else pa.int32()
    scored = counted.mapInArrow(run, f"doc_id {kind}, score double, neighbours array<struct<doc_id: {kind}, toxic: int, cosine: double>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def _curve(index: BlockMaxIndex, share: float, nearest: int) -> tuple[float, float]:
    """Calibration from the examples' votes without themselves; a flat curve at the share without examples."""
    y = index.labels
    if not len(y) or y.min() == y.max():
        share = min(max(share, 1e-6), 1 - 1e-6)
        return 0.0, float(np.log(share / (1 - share)))
    places, cosines = index.nearest(index.vectors, nearest, skip=np.arange(len(y)))
    ones, zeros = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, share / ones, (1 - share) / zeros) * len(y)
    return _logistic(index.votes(places, cosines, share), y, weight)
