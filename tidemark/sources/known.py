"""Which hashes a memory store may hold: a blocked Bloom filter per commit.

A commit of n hashes has 2**level bitmaps of 32,768 bits, about 24 to 48 bits a hash; a hash has BITS bits, all
in one bitmap. Bitmaps are rows (level, added, segment, bits), added being the commit. All commits of a
level have the same geometry, so a batch is held against any number of commits by one join on
(level, segment), which reads these bitmaps and no memory. A hash that no bitmap holds is new; the
others come with the commits that may know them, and only those folders are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap, as bitmap_construct_agg makes them.
BITMAP = 32768
BITS = 8
BITS_PER_HASH = 24
SCHEMA = "segment long, bits binary, level int, added string"


def level_for(n: int) -> int:
    """The least level with BITS_PER_HASH bits for each of n hashes."""
    return max(0, (n * BITS_PER_HASH - 1).bit_length() - BITMAP.bit_length() + 1)


def _segment(level: Column) -> Column:
    """The bitmap of a hash among 2**level: the leading bits of its digest."""
    return F.when(level == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.xxhash64("commit_hash"), F.lit(64) - level))


def _positions() -> Column:
    return F.array(*[F.pmod(F.xxhash64("commit_hash", F.lit(i)), F.lit(BITMAP)) for i in range(BITS)])


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("bit_get", byte, (position % 8).cast("int")) == 1


def append_filter(hashes: DataFrame, path: str, added: str) -> None:
    """Write the bitmaps of one commit; hashes (commit_hash) are read twice."""
    n = hashes.count()
    if n:
        level = level_for(n)
        (
            hashes.select(_segment(F.lit(level)).cast("long").alias("segment"), F.explode(_positions()).alias("position"))
            .groupBy("segment").agg(F.bitmap_construct_agg("position").alias("bits"))
            .withColumns({"level": F.lit(level), "added": F.lit(added)})
            .sortWithinPartitions("segment")
            .write.mode("append").partitionBy("level", "added").parquet(path)
        )


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def may_know(hashes: DataFrame, filters: DataFrame) -> DataFrame:
    """(commit_hash, added): the commits that may hold a hash; one that holds it is never missing.

    Falsely named are some 1 in 30,000 of the pairs of a new hash and a commit. The levels in use are folder names; as a level
    doubles what it can hold, there are a few dozen at most.
    """
    levels = [row.level for row in filters.select("level").distinct().collect()]
    asked = hashes.select("commit_hash", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")).alias("level"))
    asked = asked.select("commit_hash", "level", _segment(F.col("level")).cast("long").alias("segment"))
    return (
        asked.join(filters, ["level", "segment"])
        .where(F.forall(_positions(), lambda p: _is_set(F.col("bits"), p)))
        .select("commit_hash", "added")
    )
