"""Token lists turned into index rows inside tasks.

Memories are dealt to tasks by group (`impacts.group_of`), so a task holds whole groups, and turns their
token lists round with sorted Arrow and NumPy arrays: no row per occurrence is ever shuffled. What a
task holds is bounded by the number of tasks (`impacts.TASK_TOKENS`) and by a group's tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.impacts import COLUMNS

_LISTS = [f"_{name}" for name in COLUMNS]
_DETAILS = ["mem_id", "n_tokens", "project", "category"]
#: Rows of one Arrow batch handed back.
_ROWS = 16_384


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """What the task has been dealt, as one chunk per column."""
    kept = [batch for batch in batches if batch.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Places at which one of the keys differs from the row before; the first row is one."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _codes(values: pa.Array) -> np.ndarray:
    """A number per distinct value, null being one of them."""
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _slices(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_pydict(columns)
    for start in range(0, batch.num_rows, _ROWS):
        yield batch.slice(start, _ROWS)


def _occurrences(memories: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and code, memory, column and position of all tokens, sorted in this order."""
    words, doc, no, pos = [], [], [], []
    for i, name in enumerate(_LISTS):
        # A column without a token is null here, and has no list.
        lists = pc.split_pattern(_array(memories[name]), " ")
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words.append(lists.flatten())
        doc.append(np.repeat(np.arange(len(lists)), lengths))
        no.append(np.full(len(words[-1]), i, np.int32))
        pos.append((np.arange(len(words[-1])) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32))
    coded = pa.concat_arrays(words).dictionary_encode()
    doc, no, pos = np.concatenate(doc), np.concatenate(no), np.concatenate(pos)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(code * len(memories) + doc, kind="stable")
    return coded.dictionary, code[order], doc[order], no[order], pos[order]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memories = _table(batches)
    if memories is None:
        return
    words, code, doc, no, pos = _occurrences(memories)
    starts = _changes(code, doc, no)
    rows = pa.array(doc[starts])
    yield from _slices({
        "token": words.take(pa.array(code[starts])), "no": pa.array(no[starts]), "positions": _lists(starts, pa.array(pos)),
        **{name: _array(memories[name]).take(rows) for name in _DETAILS}})


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's memories, numbered from 0, then a row per token with the memories that hold it.

    A memory whose group and id equal those of the one before it has the same number.
    """
    memories = _table(batches)
    if memories is None:
        return
    first = _changes(memories["grp"].to_numpy(), _codes(_array(memories["mem_id"])))
    held = memories.take(pa.array(first))
    n = len(held)
    nulls = {"token": pa.nulls(n, pa.string()), "entries": pa.nulls(n, _ENTRIES)}
    yield from _slices({**nulls, "grp": _array(held["grp"]), **{name: _array(held[name]) for name in _DETAILS}})
    words, code, doc, no, _ = _occurrences(memories)
    number = np.searchsorted(first, doc, side="right") - 1
    starts = _changes(code, number)
    if not len(starts):
        return
    counts = [np.add.reduceat((no == i).astype(np.int32), starts, dtype=np.int32) for i in range(len(COLUMNS))]
    entries = pa.StructArray.from_arrays(
        [pa.array(number[starts].astype(np.int32)), *map(pa.array, counts)], names=["no", *(f"f{i}" for i in range(len(COLUMNS)))])
    lists = _changes(code[starts])
    n = len(lists)
    yield from _slices({
        "token": words.take(pa.array(code[starts][lists])), "entries": _lists(lists, entries), "grp": pa.nulls(n, pa.int64()),
        **{name: pa.nulls(n, memories.schema.field(name).type) for name in _DETAILS}})


_ENTRIES = pa.list_(pa.struct([("no", pa.int32()), *((f"f{i}", pa.int32()) for i in range(len(COLUMNS)))]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_frequencies` with stems, as one row per stem and group, its entries in the memories' order."""
    rows = _table(batches)
    if rows is None:
        return
    held = rows.filter(pc.is_null(rows["entries"]))
    words = rows.filter(pc.is_valid(rows["entries"])).combine_chunks()
    if not len(words):
        return
    lists, stems = _array(words["entries"]), _array(words["stem"]).dictionary_encode()
    entries = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    code = np.repeat(stems.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
    number = entries.field("no").to_numpy(zero_copy_only=False)
    order = np.argsort(code * len(held) + number, kind="stable")
    code, number = code[order], number[order]
    starts = _changes(code, number)
    counts = [np.add.reduceat(entries.field(f"f{i}").to_numpy(zero_copy_only=False)[order], starts, dtype=np.int32) for i in range(len(COLUMNS))]
    code, number = code[starts], number[starts]
    group = held["grp"].to_numpy()[number]
    at = pa.array(number)
    detail = {name: _array(held[name]).take(at) for name in _DETAILS}
    blocks = _changes(code, group)
    by_column = np.stack([np.add.reduceat((count > 0).astype(np.int64), blocks) for count in counts], axis=1)
    packed = pa.StructArray.from_arrays(
        [detail["mem_id"], detail["n_tokens"], *map(pa.array, counts), detail["project"], detail["category"]],
        names=["mem_id", "n_tokens", *(f"f{i}" for i in range(len(COLUMNS))), "project", "category"])
    yield from _slices({
        "stem": stems.dictionary.take(pa.array(code[blocks])), "grp": pa.array(group[blocks]),
        "n": pa.array(np.diff(np.append(blocks, len(code)))),
        "n_by_column": _lists(np.arange(len(blocks)) * len(COLUMNS), pa.array(by_column.ravel())), "entries": _lists(blocks, packed)})


def dealt(documents: DataFrame, group: Column, tasks: int) -> DataFrame:
    """Memories by group, whole groups to a task; equal ids stand together within their group.

    Tokens hold no blank and travel as one text a column, in half the room of an array.
    """
    texts = [F.when(F.size(name) > 0, F.array_join(name, " ")).alias(name) for name in _LISTS]
    return documents.select(group.alias("grp"), *_DETAILS, *texts).repartition(tasks, "grp").sortWithinPartitions("grp", "mem_id")


def postings(documents: DataFrame) -> DataFrame:
    """token, no, positions, mem_id, n_tokens, project, category from dealt memories."""
    key = documents.schema["mem_id"].dataType.simpleString()
    return documents.mapInArrow(
        _postings, f"token string, no int, positions array<int>, mem_id {key}, n_tokens int, project string, category string")


def blocks(documents: DataFrame, stem_of: Callable[[Column], Column]) -> DataFrame:
    """stem, grp, n, n_by_column, entries from dealt memories.

    Each distinct token of a task is stemmed once. The second function sees the rows of the first as they
    come: nothing between them moves rows.
    """
    key = documents.schema["mem_id"].dataType.simpleString()
    counts = ", ".join(f"f{i}: int" for i in range(len(COLUMNS)))
    words = documents.mapInArrow(
        _frequencies, f"token string, entries array<struct<no: int, {counts}>>, grp long, mem_id {key}, n_tokens int, project string, category string")
    return words.withColumn("stem", stem_of(F.col("token"))).drop("token").mapInArrow(
        _blocks,
        f"stem string, grp long, n long, n_by_column array<long>, "
        f"entries array<struct<mem_id: {key}, n_tokens: int, {counts}, project: string, category: string>>")
