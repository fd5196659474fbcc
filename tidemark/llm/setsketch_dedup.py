"""Operator 3: near-duplicate texts by SetSketch registers.

1. One pass over the texts gives each document its number of distinct word shingles, a digest of
   the whole set, and SetSketch registers: register i is the truncated logarithm, in base
   BASE, of the minimum of exponential values over the set, so registers are exponentially
   spaced. The registers of a union are the element-wise maximum of the parts' (`merged`).
2. Documents with equal sets (equal digests) form a class; only its smallest doc_id goes on.
3. Bands of registers are hashed, and each bucket is cut into overlapping ranges of set sizes. All
   classes of one range are linked to its smallest class. The connected components of these candidate
   links are families: every two classes that share a band, and whose sizes do not rule out the
   threshold, are in one family, whatever else the bucket holds.
4. Families are split into blocks of about BLOCK_MEMBERS classes or BLOCK_SHINGLES shingles, whichever is less. A task gets one pair of blocks
   and walks the link graph breadth-first: each newly reached class is compared with those not
   yet reached, first by the joint likelihood of the registers, then exactly on the full sets.
   It returns a spanning forest, never the pairs.
5. Connected components of the forests are the result.

The chance that two sets at the threshold share no band is (1 - s^r)^b; `banding` picks b and r so
that it is below 1e-6. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.llm.components import components
from tidemark.session import stage

BASE = 1.001
RATE = 20.0
TOP = 65_534
#: Log likelihood ratio beyond which registers rule a similarity out.
CERTAIN = 25.0
BLOCK_MEMBERS = 1024
#: Shingles of a block together, on average (a block cannot be smaller than one text's set): a pair of blocks
#: holds about 16 MB of them, and comparing them takes some seven times that.
BLOCK_SHINGLES = 1 << 20
#: Texts are read in blocks of this many bytes; words, shingles and registers take about ten times that.
TEXT_BYTES = 4 << 20
MAX_MISS = 1e-6


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows): the most rows with at most 28 bands and a miss chance of at most MAX_MISS."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(MAX_MISS) / np.log1p(-(similarity**rows))))
        if bands <= 28:
            return bands, rows
    return bands, 1


def _multipliers(registers: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = textkit.mixed(np.arange(1, 2 * registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:registers] | np.uint64(1), seeds[registers:]


def sketch(shingles: np.ndarray, registers: int) -> np.ndarray:
    """SetSketch registers (uint16) of a set of 64-bit values; all 0 for the empty set."""
    times, plus = _multipliers(registers)
    least = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        part = shingles[start : start + 2048]
        np.minimum(least, (times[:, None] * part + plus[:, None]).min(axis=1), out=least)
    if not len(shingles):
        return np.zeros(registers, np.uint16)
    low = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(low) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _step(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity) -> np.ndarray:
    """Joint log likelihood of a similarity, given how many registers are greater, smaller and equal."""
    u = size_a / (size_a + size_b)
    similarity = np.minimum(similarity, np.minimum(u / (1 - u), (1 - u) / u))
    p, q = _step(u - (1 - u) * similarity), _step((1 - u) - u * similarity)
    tiny = 1e-12
    return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))


def may_reach(regs_a: np.ndarray, regs_b: np.ndarray, size_a, size_b, similarity: float) -> np.ndarray:
    """False where the registers rule out that the pair is as similar as `similarity`.

    The best similarity is sought on a grid below the threshold; a pair is ruled out if it is
    likelier than the threshold by CERTAIN.
    """
    more, less = (regs_a > regs_b).sum(axis=1), (regs_a < regs_b).sum(axis=1)
    same = regs_b.shape[1] - more - less
    size_a, size_b = np.asarray(size_a, float), np.asarray(size_b, float)
    at = log_likelihood(more, less, same, size_a, size_b, similarity)
    best = np.max([log_likelihood(more, less, same, size_a, size_b, s) for s in np.linspace(0, similarity, 12)], axis=0)
    return best - at <= CERTAIN


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text shorter than a shingle is one as a whole."""
    data, offsets = textkit.utf8(texts)
    data = textkit.lowered(data)
    starts, ends, ranges = textkit.word_spans(data, offsets)
    codes, dictionary = textkit.word_codes(data, starts, ends)
    hashes = textkit.word_hashes(dictionary)[codes] if len(codes) else np.empty(0, np.uint64)
    runs = textkit.run_hashes(hashes, width) if len(hashes) >= width else np.empty(0, np.uint64)
    for a, b in zip(ranges[:-1], ranges[1:], strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield textkit.run_hashes(hashes[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.empty(0, np.uint64)


def sketched(docs: DataFrame, width: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """Per row: doc_id, n_shingles, digest (null for an empty set), band keys, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in textkit.blocks(batches, "text", TEXT_BYTES):
            sizes, digests, keys, registers = [], [], [], []
            for s in shingle_sets(block.column("text"), width):
                sizes.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs = sketch(s, bands * rows)
                registers.append(regs.tobytes())
                keys.append(_band_keys(regs, bands, rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(registers, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "registers"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, registers binary")


def _band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in regs.reshape(bands, rows).T:
        key = textkit.mixed(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return key.view(np.int64)


def _families(classes: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, family) of the classes that share a bucket with another one of about their size.

    Sizes are cut into steps of a factor 1 / similarity, and a class enters each bucket under its own
    step and the next one: two sets that can be similar enough share at least one of the two.
    """
    # Slightly wider than the threshold, so that rounding never parts two sets by two steps.
    width = max(-np.log(similarity), 1e-6) * (1 + 1e-9)
    step = F.floor(F.log("n_shingles") / F.lit(float(width)))
    keys = F.flatten(F.transform("bands", lambda band: F.array(F.xxhash64(band, step), F.xxhash64(band, step + 1))))
    entries = classes.select("doc_id", F.explode(keys).alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = entries.join(hubs, "bucket").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    return components(pairs).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))


def _matrix(column, registers: int) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), registers)


class _Block:
    """Full sets of the members of one pair of blocks, ready for one-against-many intersections."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[number] > 1
        # A shingle of one member only never counts in an intersection.
        renumber = np.cumsum(count > 1) - 1
        number, owner = renumber[number[shared]], owner[shared]
        order = np.argsort(number, kind="stable")
        self.members = owner[order]
        self.at = np.append(0, np.cumsum(np.bincount(number, minlength=int((count > 1).sum()))))
        self.own = np.split(number, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])

    def intersections(self, i: int) -> np.ndarray:
        """Shared shingles of member i with every member, through the inverted lists."""
        own = self.own[i]
        lengths = self.at[own + 1] - self.at[own]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[own] - (ends - lengths), lengths)
        return np.bincount(self.members[take], minlength=len(self.sizes))


def _forest(ids: list, sets: list[np.ndarray], regs: np.ndarray, num: int, den: int) -> list[tuple]:
    """(member, root) links between all members that are connected by similar pairs."""
    block = _Block(sets)
    rest = np.argsort(np.array(ids), kind="stable")
    links = []
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            n = block.sizes[i]
            near = (den * np.minimum(n, block.sizes[rest]) >= num * np.maximum(n, block.sizes[rest]))
            near[near] = may_reach(regs[i][None, :], regs[rest[near]], n, block.sizes[rest[near]], num / den)
            if not near.any():
                continue
            both = block.intersections(i)[rest]
            linked = near & (den * both >= num * (n + block.sizes[rest] - both))
            queue += list(rest[linked])
            links += [(ids[j], ids[root]) for j in rest[linked]]
            rest = rest[~linked]
    return links


def _links(docs: DataFrame, families: DataFrame, classes: DataFrame, width: int, registers: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """Spanning links (a, b) of the similar pairs within families."""
    sized = families.join(classes.select("doc_id", "n_shingles"), "doc_id")
    size = sized.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    n_blocks = F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.least(F.col("shingles") / BLOCK_SHINGLES, F.col("n").cast("double")))).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    placed = (
        families.join(size, "family").withColumn("blocks", n_blocks).withColumn("block", block)
        .join(classes.select("doc_id", "registers"), "doc_id")
        .select("doc_id", "family", "blocks", "block", "registers"))
    texts = docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).join(placed, "doc_id")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textkit.blocks(batches, "text", TEXT_BYTES):
            sets = [s.tobytes() for s in shingle_sets(b.column("text"), width)]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "family", "blocks", "block", "registers")] + [pa.array(sets, pa.binary())],
                ["doc_id", "family", "blocks", "block", "registers", "shingles"])

    kind = classes.schema["doc_id"].dataType.simpleString()
    sets = texts.select("doc_id", "family", "blocks", "block", "registers", "text").mapInArrow(
        with_sets, f"doc_id {kind}, family {kind}, blocks int, block int, registers binary, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = sets.select("doc_id", "family", "registers", "shingles", "block", other).select(
        "doc_id", "family", "registers", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("doc_id")
        found = _forest(
            group["doc_id"].tolist(), [np.frombuffer(s, np.uint64) for s in group["shingles"]],
            _matrix(group["registers"], registers), num, den) if len(group) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"]).astype(group["doc_id"].dtype)

    return tasks.groupBy("family", "i", "j").applyInPandas(walk, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (smallest key reachable), kept.

    Two documents are linked if den * |intersection| >= num * |union| of their sets of `width`-word
    shingles (words without white space, A-Z lower-cased). With fewer words the whole sequence
    is the one shingle; without words (also null text) the set is empty and linked with nothing.
    Repeated rows of one key are one document: all of them carry the same result, and kept holds
    for each. A row with a null key is linked with nothing (component_id null, kept true). Extra
    columns are ignored.
    """
    bands, rows = banding(num / den)
    all_rows = stage(sketched(docs, width, bands, rows, key, text), "sketches")
    classes = all_rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min_by(F.struct("doc_id", "n_shingles", "bands", "registers"), "doc_id").alias("c")).select("digest", "c.*")
    classes = stage(classes, "classes")
    families = stage(_families(classes, num / den), "families")
    found = _links(docs, families, classes, width, bands * rows, num, den, key, text)
    merged_ids = components(found)
    roots = classes.select("digest", "doc_id").join(
        merged_ids.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    ).select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return all_rows.select("doc_id", "n_shingles", "digest").join(roots, "digest", "left").select(
        F.col("doc_id").alias(key), "n_shingles", own.alias("component_id"),
        (own.eqNullSafe(F.col("doc_id"))).alias("kept"))
