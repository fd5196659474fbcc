"""Substring search by a trigram index.

The index has, per trigram of code points and part of the memories, the memories whose text holds it.
A LIKE pattern's literal runs (between % and _) name the trigrams that every match holds. Of those the
rarest few are looked up, the memories that hold them all are candidates, and LIKE decides. No memory
row meets a query that it shares no trigram with. Patterns without three literal characters in a row
have no trigram: they need the scan (`search.search_like_all`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_lower
from tidemark.session import shared_path, stage

BUCKETS = 32
#: Memories of one part; a trigram of every memory is a row per part.
PART = 4096
#: Characters of one part, and those that one task takes up.
PART_CHARS, TASK_CHARS = 1 << 23, 1 << 26
#: Trigrams of a pattern that are looked up, rarest first.
RAREST = 4
_ROWS = 16_384


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    first = F.split(text, "")
    second, third = (F.slice(first, n, F.greatest(F.size(first), F.lit(1))) for n in (2, 3))
    # The shorter lists end in nulls here, and a run with a null is none.
    runs = F.zip_with(F.zip_with(first, second, lambda a, b: F.concat(a, b)), third, lambda ab, c: F.concat(ab, c))
    return F.array_distinct(F.array_compact(runs))


def _bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _part_lists(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """gram, n, mem_ids of one part: each text counts a trigram once."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return
    doc = np.repeat(np.arange(len(texts)), lengths)
    # 21 bits hold a code point; a run must not reach into the next text.
    runs, held = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:], doc[:-2]
    whole = held == doc[2:]
    runs, held = runs[whole], held[whole]
    order = np.argsort(runs, kind="stable")
    runs, held = runs[order], held[order]
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    first = new.copy()
    first[1:] |= held[1:] != held[:-1]
    starts = np.append(np.flatnonzero(new[first]), np.count_nonzero(first)).astype(np.int32)
    runs, held = runs[new], ids.take(pa.array(held[first]))
    mask = (1 << 21) - 1
    letters = np.stack([runs >> 42, (runs >> 21) & mask, runs & mask], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for at in range(0, len(runs), _ROWS):
        offsets = starts[at:at + _ROWS + 1]
        grams = [letters[3 * i:3 * i + 3] for i in range(at, at + len(offsets) - 1)]
        lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), held.slice(offsets[0], offsets[-1] - offsets[0]))
        yield pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.string()), "n": pa.array(np.diff(offsets)), "mem_ids": lists})


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of each part; a task's rows come by part."""
    current, ids, texts = None, [], []
    for batch in batches:
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        borders = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for start, end in zip(borders, borders[1:]):
            if start == end:
                continue
            if parts[start] != current and ids:
                yield from _part_lists(pa.concat_arrays(ids), texts)
                ids, texts = [], []
            current = parts[start]
            ids.append(batch.column("mem_id").slice(start, end - start))
            texts.extend(batch.column("text").slice(start, end - start).to_pylist())
    if ids:
        yield from _part_lists(pa.concat_arrays(ids), texts)


def append_trigrams(memories: DataFrame, path: str, key: str = "mem_id") -> None:
    """Add memories that the index does not hold yet. One writer per index. A null content holds nothing.

    Memories are dealt to tasks by part, and a task turns the texts of a part into its lists. They are
    written from there, a file per task and folder, sorted by trigram within it.
    """
    spark = memories.sparkSession
    n, chars = memories.agg(F.count(F.lit(1)), F.sum(F.length("content"))).first()
    parts = max(1, -(-n // PART), -(-(chars or 0) // PART_CHARS))
    tasks = max(-(-(chars or 0) // TASK_CHARS), min(spark.sparkContext.defaultParallelism, parts))
    rows = memories.select(
        F.col(key).alias("mem_id"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), ascii_lower(F.col("content")).alias("text")
    ).filter("mem_id is not null and text is not null")
    kind = rows.schema["mem_id"].dataType.simpleString()
    dealt = rows.repartition(tasks, "part").sortWithinPartitions("part", "mem_id")
    lists = dealt.mapInArrow(_lists, f"gram string, n int, mem_ids array<{kind}>").withColumn("bucket", _bucket_of(F.col("gram")))
    lists.sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(path)


def build_trigrams(memories: DataFrame, path: str | None = None, key: str = "mem_id") -> DataFrame:
    spark = memories.sparkSession
    path = path or shared_path(spark, "trigrams")
    append_trigrams(memories, path, key)
    return read_trigrams(spark, path)


def read_trigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pattern_trigrams(text: Column) -> Column:
    """Trigrams that every text LIKE %text% holds."""
    runs = F.split(ascii_lower(text), "[%_]")
    return F.array_distinct(F.flatten(F.transform(runs, trigrams)))


def candidates(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, mem_id) of the memories that hold the rarest trigrams of the written queries (query_id, _query)."""
    grams = asked.select("query_id", F.explode(pattern_trigrams(F.col("_query"))).alias("gram")).withColumn("bucket", _bucket_of(F.col("gram")))
    grams = stage(grams, "like-trigrams")
    buckets = [row[0] for row in grams.select("bucket").distinct().collect()]  # at most BUCKETS
    index = index.filter(F.col("bucket").isin(buckets))
    counts = index.select("bucket", "gram", "n").join(grams, ["bucket", "gram"]).groupBy("query_id", "gram").agg(F.sum("n").alias("n"))
    # A trigram that no memory holds counts 0: it is the rarest and lets nothing pass.
    ranked = grams.join(counts, ["query_id", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("n", "gram")
    chosen = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= RAREST)
    chosen = stage(chosen.select("query_id", "bucket", "gram"), "like-rarest")
    wanted = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    held = index.select("bucket", "gram", "mem_ids").join(chosen, ["bucket", "gram"]).select("query_id", F.explode("mem_ids").alias("mem_id"))
    return held.groupBy("query_id", "mem_id").agg(F.count(F.lit(1)).alias("held")).join(wanted, "query_id").filter("held = wanted").select("query_id", "mem_id")
