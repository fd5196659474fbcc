"""Operator 13: language identification by family first, then one language against another within it.

A text's features are its letters' byte n-grams in lower case (one and three bytes, a space at
word ends; anything but letters and marks beyond ASCII counts as a space), hashed to `DIMS` places.
Languages fall into families by average linkage over the cosine of their mean profiles. A
multinomial model over the n-gram counts of all learning rows picks the family. Within a family,
each pair of languages has a linear support vector machine, trained in a task of its own on at most
`EXAMPLES` rows of each; the language with most votes wins, ties by the sum of margins.

Beside Spark's Arrow batch a task holds a few copies of a block's texts (1 MB, or one larger text) and
what is bounded: counts are dense for one block of `_BLOCK_ROWS` rows (8 MB as 64-bit numbers), n-grams
are found in steps of `_STEP` bytes, a machine's rows are one matrix of at most 2 * `EXAMPLES` rows (32 MB).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.session import stage

DIMS = 1 << 12
#: The classifier of a pair of languages is fitted on at most this many rows of each.
EXAMPLES = 1000
#: They are drawn in so many equal parts, by hash, so that no task sees all texts of a language.
PARTS = 20
#: Languages (distinct labels) a model may have; more are refused.
MAX_LANGUAGES = 256
UNKNOWN = "und"

_BLOCK_BYTES = 1 << 20
_BLOCK_ROWS = 256
#: Bytes of a block looked at together; a step takes some 60 times as much.
_STEP = 1 << 18
_EPOCHS = 20
_COST = 4.0
#: Log-odds of a whole text are far too sure, as its n-grams overlap; they are taken per this many.
_EVIDENCE = 200.0

_LETTERS = regex.compile(r"\p{L}")
_KEEP = np.zeros(256, np.uint8)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[0x80:] = np.arange(0x80, 0x100)
_KEEP[_KEEP == 0] = 32
_HASH = np.uint32(0x9E3779B1)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Which texts hold a letter (Unicode category L); a null text does not."""
    data, offsets = textkit.utf8(texts)
    filled = np.diff(offsets) > 0
    out = np.zeros(len(texts), bool)
    if filled.any():
        out[filled] = np.logical_or.reduceat(((data | 32) >= 97) & ((data | 32) <= 122), offsets[:-1][filled])
    for i in np.flatnonzero(~out & filled):
        out[i] = _LETTERS.search(texts[int(i)].as_py()) is not None
    return out


def profiles(texts: pa.Array) -> np.ndarray:
    """Counts of n-grams per text, (texts, DIMS); whole texts, null as empty."""
    n = len(texts)
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), lower, pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string()))
    data, offsets = textkit.utf8(padded)
    data = _KEEP[data]
    counts = np.zeros(n * DIMS, np.int64)
    # Every text begins and ends with blanks, so no run of three with a letter in the middle leaves its text.
    for low in range(0, len(data), _STEP):
        high = min(low + _STEP, len(data))
        first, last = np.searchsorted(offsets, [low, high - 1], side="right") - 1
        row = np.repeat(np.arange(last - first + 1) * DIMS, np.diff(np.clip(offsets[first : last + 2], low, high)))
        inside = np.flatnonzero(data[low:high] != 32)
        row, middle = row[inside], inside + low
        before, here, after = (data[middle + k].astype(np.uint32) for k in (-1, 0, 1))
        triple = (before << np.uint32(16)) | (here << np.uint32(8)) | after
        part = counts[first * DIMS : (last + 1) * DIMS]
        part += np.bincount(row + here, minlength=len(part))
        part += np.bincount(row + 256 + ((triple * _HASH) >> np.uint32(16)).astype(np.int64) % (DIMS - 256), minlength=len(part))
    return counts.reshape(n, DIMS)


def _units(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts at length one; a text without n-grams stays zero."""
    roots = np.sqrt(counts.astype(np.float32))
    norms = np.sqrt((roots * roots).sum(axis=1, keepdims=True))
    return roots / np.where(norms == 0, 1, norms)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return textkit.blocks(batches, "text", _BLOCK_BYTES, _BLOCK_ROWS)


def _language_counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """Per language the summed n-gram counts of all learning rows; one small row per language leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in _blocks(batches):
            coded = block.column("lang").dictionary_encode()
            counts, numbers = profiles(block.column("text")), coded.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(coded.dictionary.to_pylist()):
                sums[lang] = sums.get(lang, 0) + counts[numbers == i].sum(axis=0)
        for lang, n in sums.items():
            places = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(places), pa.string()), pa.array(places, pa.int32()), pa.array(n[places], pa.int64())], names=["lang", "place", "n"])

    summed = rows.select("lang", "text").mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for lang, place, n in summed.collect():
        out.setdefault(lang, np.zeros(DIMS, np.int64))[place] = n
    return dict(sorted(out.items()))


def families(counts: dict[str, np.ndarray]) -> dict[str, int]:
    """Language -> family: average linkage down to ceil(sqrt(languages)) families, ties by name."""
    names = sorted(counts)
    if not names:
        return {}
    units = _units(np.stack([counts[name] for name in names]).astype(np.float64)).astype(np.float64)
    near = units @ units.T
    groups = [[i] for i in range(len(names))]
    while len(groups) > math.ceil(math.sqrt(len(names))):
        best = max(((near[np.ix_(a, b)].mean().round(12), -x, -y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        x, y = -best[1], -best[2]
        groups[x] = groups[x] + groups.pop(y)
    return {names[i]: f for f, group in enumerate(groups) for i in group}


def fit_pair(features: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, bias and margin scale of a linear support vector machine (dual coordinate descent, hinge loss).

    Both classes weigh the same whatever their numbers of rows. Deterministic.
    """
    return _fit(np.hstack([features, np.ones((len(features), 1), np.float32)]), signs)


def _fit(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float, float]:
    """As `fit_pair`, of features whose last column is one; nothing else of their size is made."""
    bound = np.where(signs > 0, len(signs) / (2 * max((signs > 0).sum(), 1)), len(signs) / (2 * max((signs < 0).sum(), 1))) * _COST
    parts = [slice(low, low + _BLOCK_ROWS) for low in range(0, len(x), _BLOCK_ROWS)]
    norms = np.concatenate([(x[part] * x[part]).sum(axis=1) for part in parts])
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(_EPOCHS):
        moved = 0.0
        for i in order.permutation(len(x)):
            gradient = signs[i] * float(x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), bound[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * signs[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    margins = signs * np.concatenate([x[part] @ w for part in parts])
    return w[:-1], float(w[-1]), float(max(np.median(margins), 1e-6))


def _trained(group: pd.DataFrame) -> pd.DataFrame:
    """The machine of one pair of languages, from all its rows."""
    group = group.sort_values(["sign", "number"], kind="stable")
    x = np.zeros((len(group), DIMS + 1), np.float32)
    x[:, DIMS] = 1
    for i, (places, amounts) in enumerate(zip(group["places"], group["amounts"])):
        x[i, np.frombuffer(places, np.uint16)] = np.frombuffer(amounts, np.float32)
    w, bias, scale = _fit(x, group["sign"].to_numpy())
    return pd.DataFrame({"pair": [group["pair"].iloc[0]], "w": [w.astype(np.float64).tobytes()], "bias": [bias], "scale": [scale]})


def _pair_models(examples: DataFrame, family: dict[str, int]) -> dict[tuple[str, str], tuple[np.ndarray, float, float]]:
    """A machine per pair of languages of one family, each trained in its own task.

    Copies of an example (equal number) are read, but a task passes on one of them only.
    """
    pairs = [(a, b) for a in family for b in family if a < b and family[a] == family[b]]
    if not pairs:
        return {}
    spark = examples.sparkSession
    table = spark.createDataFrame([(i, lang, 1.0 if lang == a else -1.0) for i, (a, b) in enumerate(pairs) for lang in (a, b)], "pair int, lang string, sign double")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for block in _blocks(batches):
            tags = list(zip(block.column("lang").to_pylist(), block.column("number").to_pylist()))
            fresh = [tag not in seen and not seen.add(tag) for tag in tags]
            block = block.filter(pa.array(fresh, pa.bool_()))
            units = _units(profiles(block.column("text")))
            places = [np.flatnonzero(u).astype(np.uint16) for u in units]
            yield pa.RecordBatch.from_arrays([
                block.column("lang"), block.column("number"), pa.array([p.tobytes() for p in places], pa.binary()),
                pa.array([u[p].tobytes() for u, p in zip(units, places)], pa.binary())], names=["lang", "number", "places", "amounts"])

    vectors = stage(examples.select("lang", "number", "text").mapInArrow(sparse, "lang string, number long, places binary, amounts binary").dropDuplicates(["lang", "number"]), "lang-examples")
    trained = vectors.join(F.broadcast(table), "lang").groupBy("pair").applyInPandas(_trained, "pair int, w binary, bias double, scale double")
    return {pairs[r["pair"]]: (np.frombuffer(r["w"], np.float64), r["bias"], r["scale"]) for r in trained.collect()}


class Model:
    """Family model and pair machines; small, so that every task can hold it."""

    def __init__(self, counts: dict[str, np.ndarray], family: dict[str, int], machines: dict):
        self.family = family
        self.members = [sorted(lang for lang, f in family.items() if f == n) for n in range(max(family.values(), default=-1) + 1)]
        sums = np.array([np.sum([counts[lang] for lang in group], axis=0) for group in self.members], np.float64).reshape(-1, DIMS) + 0.5
        self.logs = np.log(sums / sums.sum(axis=1, keepdims=True))
        self.machines = machines

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        letters = has_letter(texts)
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.members or not len(texts):
            return names, scores
        counts = profiles(texts)
        units = _units(counts)
        totals = counts.sum(axis=1)
        odds = (counts @ self.logs.T) * (_EVIDENCE / np.maximum(totals, _EVIDENCE))[:, None]
        odds -= odds.max(axis=1, keepdims=True)
        shares = np.exp(odds)
        shares /= shares.sum(axis=1, keepdims=True)
        chosen = odds.argmax(axis=1)
        for f, group in enumerate(self.members):
            rows = np.flatnonzero((chosen == f) & letters)
            if not len(rows):
                continue
            votes, margins, sure = (np.zeros((len(rows), len(group))) for _ in range(3))
            for (a, b), (w, bias, scale) in self.machines.items():
                if self.family[a] == f:
                    margin = (units[rows] @ w + bias) / scale
                    p = 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))
                    for lang, m, q in ((a, margin, p), (b, -margin, 1 - p)):
                        i = group.index(lang)
                        votes[:, i] += m > 0
                        margins[:, i] += m
                        sure[:, i] += q
            best = (votes + 1e-6 * np.tanh(margins / max(len(group), 1))).argmax(axis=1)
            inner = sure[np.arange(len(rows)), best] / (len(group) - 1) if len(group) > 1 else 1.0
            for row, language in zip(rows, best):
                names[row] = group[language]
            scores[rows] = np.clip(shares[rows, f] * inner, 0, 1)
        return names, scores


def fit(docs: DataFrame, examples: int = EXAMPLES) -> Model:
    """The model learned from (text, lang) of docs: rows with null text or lang, or without letters, teach nothing.

    The family model counts all rows; machines see at most `examples` rows per language: in each of
    `PARTS` parts by hash of (text, lang) those with the least hash, each distinct hash once.
    """
    rows = docs.select(F.col("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = _language_counts(rows)
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{len(counts)} languages; at most {MAX_LANGUAGES} can be learned")
    family = families(counts)
    hashed = rows.withColumn("number", F.xxhash64("text", "lang"))
    part = Window.partitionBy("lang", F.pmod("number", F.lit(PARTS))).orderBy("number")
    least = hashed.select("lang", "number").distinct().withColumn("place", F.row_number().over(part)).where(F.col("place") <= max(1, examples // PARTS))
    picked = hashed.join(F.broadcast(least.select("lang", "number")), ["lang", "number"], "left_semi")
    return Model(counts, family, _pair_models(picked, family))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row of docs, whole texts.

    lang_pred is a learned language, or `und` with score 0 if the text is null or has no letter, or
    if nothing was learned. score is the family's share times the pair machines' mean confidence.
    Repeated rows and null keys come out as often as they go in; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            names, scores = shared.value.predict(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """Rows no model learns from: crc32 of the key as text, modulo 4, is 2; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a model of the rows that are not held out, applied to all rows."""
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
