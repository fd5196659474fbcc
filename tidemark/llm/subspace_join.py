"""Operator 5: embedding near-duplicates by a subspace pigeonhole join.

For unit vectors, cosine >= c means a squared distance of at most 2 - 2c. A rotation keeps
distances; after it the dimensions are split into BLOCKS blocks, each with a share of the squared
distance in proportion to its share of the spread. If every block of a pair exceeded its share, the
pair would exceed the whole: so each linked pair is within its share in at least one block
(pigeonhole). The rotation goes to the principal axes, so each block leads with a wide axis.

Per label and block a range join finds those pairs: a vector lies in the strip of its leading
coordinate, strips are as wide as the block's radius, and a pair within the radius lies in one strip
or in neighbours. Populous strips are split into cells of bounded size that meet in pairs.
A task gets two cells, finds pairs within the block's share, and verifies them exactly (cosine in
double precision). A pair is counted only by the first block in which it is within its share.

Equal vectors of a label are one class with a count, so a vector that holds a third of all rows is
one row here. Tasks return counts and spanning links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import stage

BLOCKS = 4
#: Vectors of one strip that one task may get from either side.
CELL_ROWS = 2048
SLACK = 1e-9


def _floats(column) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _unit(row: list | None) -> bytes | None:
    if not row or None in row:
        return None
    x = np.array(row, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x /= top
    return (x / np.sqrt((x * x).sum())).tobytes()


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit) of every row; unit is the unit vector's bytes in double precision.

    It is null for rows that link with nothing: null ids or labels, null, empty or zero vectors, null
    or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, units = [], [], []
            for i, label, row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
                ids.append(i)
                labels.append(label)
                units.append(None if i is None or label is None else _unit(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("vec_id").type), pa.array(labels, batch.schema.field("label").type), pa.array(units, pa.binary())],
                ["vec_id", "label", "unit"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit binary")


def rotations(units: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the rotation to the principal axes of all vectors of that dimension.

    Each partition gives one matrix of sums; the driver adds them up (one matrix per partition).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            lengths = np.array([len(u) for u in batch.column("unit").to_pylist()])
            for n in np.unique(lengths):
                x = _floats(batch.column("unit").filter(pa.array(lengths == n)))
                s = sums.setdefault(int(n) // 8, [0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + len(x), s[1] + x.sum(0), s[2] + x.T @ x
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([s[0] for s in sums.values()]), pa.array([s[1].tolist() for s in sums.values()]),
                 pa.array([s[2].ravel().tolist() for s in sums.values()])], ["dims", "n", "total", "gram"])

    parts = units.select("unit").mapInArrow(run, "dims long, n long, total array<double>, gram array<double>")
    added = parts.select("dims", "n", F.posexplode(F.concat("total", "gram"))).groupBy("dims", "pos").agg(F.sum("col").alias("x"), F.sum("n").alias("n"))
    rows = added.groupBy("dims").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("x")).collect()
    result = {}
    for row in rows:
        d = row["dims"]
        mean, gram = np.array(row["x"][:d]) / row["n"], np.array(row["x"][d:]).reshape(d, d) / row["n"]
        spread, axes = np.linalg.eigh(gram - np.outer(mean, mean))
        result[d] = _dealt(np.maximum(spread[::-1], 0), axes[:, ::-1])
    return result


def _dealt(spread: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """Axes dealt out to the blocks in turn; the blocks; their shares of the squared distance."""
    blocks = min(BLOCKS, len(spread))
    order = np.concatenate([np.arange(b, len(spread), blocks) for b in range(blocks)])
    sizes = [len(range(b, len(spread), blocks)) for b in range(blocks)]
    stops = np.cumsum(sizes)
    parts = [slice(int(e - n), int(e)) for e, n in zip(stops, sizes, strict=True)]
    own = np.array([spread[order][p].sum() for p in parts]) + 1e-6
    return np.ascontiguousarray(axes[:, order]), parts, own / own.sum()


def _placed(classes: DataFrame, turns: dict, budget: float) -> DataFrame:
    """Each class once per block: label, dims, block, strip, and the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(u) for u in batch.column("unit").to_pylist()], np.int64)
            for n in np.unique(lengths):
                own = batch.filter(pa.array(lengths == n))
                axes, parts, shares = turns[int(n) // 8]
                x = _floats(own.column("unit"))
                for b, (part, share) in enumerate(zip(parts, shares, strict=True)):
                    lead = x @ axes[:, part.start]
                    strip = np.floor(lead / (np.sqrt(budget * share) * (1 + 1e-6) + SLACK)).astype(np.int64)
                    k = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [own.column("label"), pa.array(np.full(k, n // 8)), pa.array(np.full(k, b)), pa.array(strip), own.column("vec_id"), own.column("cls"), own.column("copies"), own.column("unit")],
                        ["label", "dims", "part", "strip", "vec_id", "cls", "copies", "unit"])

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return classes.select("label", "vec_id", "cls", "copies", "unit").mapInArrow(
        run, f"label {kinds['label']}, dims long, part long, strip long, vec_id {kinds['vec_id']}, cls long, copies long, unit binary")


def _meetings(placed: DataFrame) -> DataFrame:
    """Each row in every pair of cells (lo, hi) that its task needs: cells of one strip or neighbours."""
    where = ["label", "dims", "part", "strip"]
    sizes = placed.groupBy(where).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("cells"))
    nearby = sizes.join(
        sizes.select("label", "dims", "part", (F.col("strip") - 1).alias("strip"), F.col("cells").alias("after")), where, "left",
    ).join(sizes.select("label", "dims", "part", (F.col("strip") + 1).alias("strip"), F.col("cells").alias("before")), where, "left")
    rows = placed.join(nearby, where).withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int"))
    span = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(0)) - 1)
    empty = F.array().cast("array<int>")
    same = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda c: F.struct(
        F.col("strip").alias("at"), F.least("cell", c).alias("lo"), F.greatest("cell", c).alias("hi"), F.lit(0).alias("side")))
    below = F.transform(F.when(F.col("after").isNull(), empty).otherwise(span(F.col("after"))), lambda c: F.struct(
        F.col("strip").alias("at"), F.col("cell").alias("lo"), c.alias("hi"), F.lit(1).alias("side")))
    above = F.transform(F.when(F.col("before").isNull(), empty).otherwise(span(F.col("before"))), lambda c: F.struct(
        (F.col("strip") - 1).alias("at"), c.alias("lo"), F.col("cell").alias("hi"), F.lit(2).alias("side")))
    return rows.select(
        "label", "dims", "part", "cell", "vec_id", "cls", "copies", "unit", F.explode(F.concat(same, below, above)).alias("m")
    ).select("label", "dims", "part", "cell", "vec_id", "cls", "copies", "unit", "m.*").withColumn("across", F.col("side") > 0)


def _pairs_of(group: pd.DataFrame, turns: dict, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked pairs that this group has to report."""
    axes, parts, shares = turns[int(group["dims"].iloc[0])]
    part, budget = int(group["part"].iloc[0]), 2 - 2 * cosine
    x = _floats(group["unit"])
    side, cell = group["side"].to_numpy(), group["cell"].to_numpy()
    if side.any():
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    elif group["lo"].iloc[0] != group["hi"].iloc[0]:
        left, right = np.flatnonzero(cell == group["lo"].iloc[0]), np.flatnonzero(cell == group["hi"].iloc[0])
    else:
        left = right = np.arange(len(x))
    own = x @ axes[:, parts[part]]
    norm = (own * own).sum(1)
    found_i, found_j = [], []
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        square = norm[rows][:, None] + norm[right][None, :] - 2 * own[rows] @ own[right].T
        i, j = np.nonzero(square <= budget * shares[part] + 1e-7)
        i, j = rows[i], right[j]
        if left is right:
            i, j = i[i < j], j[i < j]
        # Exactly, pair by pair: the cosine, then the first block that holds the pair.
        for at in range(0, len(i), 65_536):
            a, b = i[at : at + 65_536], j[at : at + 65_536]
            linked = (x[a] * x[b]).sum(1) >= cosine
            a, b = a[linked], b[linked]
            apart = np.square((x[a] - x[b]) @ axes)
            inside = np.stack([apart[:, p].sum(1) <= budget * s + SLACK for p, s in zip(parts, shares, strict=True)], axis=1)
            first = np.argmax(inside, axis=1) == part
            found_i.append(a[first])
            found_j.append(b[first])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each member the smallest position it is connected to."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all() and (root[i] == root[j]).all():
            break
    return root


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null and the cosine of their vectors is at
    least `cosine`. Null or zero vectors, null or non-finite components, null ids and vectors of
    another length link with nothing: n_links 0, their own component (null for a null id), kept.
    Rows of one vec_id are separate vectors for n_links and one member of a component. Other columns
    are ignored.
    """
    every = stage(unit_vectors(vectors), "units")
    units = every.where("unit is not null").withColumn("cls", F.xxhash64("label", "unit"))
    grouped = units.groupBy("label", "unit", "cls").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    classes = stage(grouped, "vectors")
    turns = rotations(classes)
    meetings = _meetings(_placed(classes, turns, 2 - 2 * cosine))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "cls"], ignore_index=True)
        i, j = _pairs_of(group, turns, cosine)
        copies = group["copies"].to_numpy()
        links = np.zeros(len(group), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        ids = group["vec_id"].to_numpy()
        some = links > 0
        return pd.DataFrame({"vec_id": ids[some], "cls": group["cls"].to_numpy()[some], "links": links[some], "root": ids[_forest(len(ids), i, j)][some]})

    partial = stage(meetings.groupBy("label", "dims", "part", "at", "lo", "hi", "across").applyInPandas(
        count, f"vec_id {kind}, cls long, links long, root {kind}"), "links")
    merged = components(partial.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    sums = partial.groupBy("cls").agg(F.sum("links").alias("links"))
    results = classes.join(sums, "cls", "left").join(merged.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "label", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    found = units.drop("cls").join(results, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    unusable = every.where("unit is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(unusable).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
