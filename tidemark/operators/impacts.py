"""Ranked retrieval over impact blocks (R2, R6): an exact top-k that passes over blocks below the k-th best.

Memories are dealt to groups of about `GROUP` of nearly equal length. The index has one row per stem
and group: how many of the group's memories hold the stem (in any column, and in each), the pairs of
frequency and length that no other memory of the block beats in both (impacts), and the entries
themselves, one per memory. From the impacts follows the greatest part of a score that the block can give,
whatever the mean length has become by the time of the query; counts per stem add up over blocks, so
appending never rewrites anything.

A query adds up its units' bounds per group, reading no entries. The two best groups of each query are
scored first; their k-th best score is a floor, and of the other groups only those whose bound reaches it are
scored at all. Scores are exact decimals, as in `search.ranked`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.session import stage

GROUP = 128
#: Tokens of one group, beyond a single memory's.
GROUP_TOKENS = 1 << 18
#: Tokens that one task turns into index rows, and so writes to one file per folder, and those a task is not made for.
TASK_TOKENS, LEAST_TOKENS = 4_000_000, 250_000
#: Groups of each query that are scored before the floor is known.
FIRST_GROUPS = 2
#: Up to this many stems are handed to the scan as literals; beyond, the join alone selects them.
LITERALS = 1_000
# Bounds are sums of doubles, scores of decimals: a bound must miss the floor by more than rounding.
_SLACK = 1e-9
COLUMNS = ["content", "category", "subcategory", "project"]
_N_COLUMNS = len(COLUMNS)


def group_of(documents: DataFrame, label: str) -> tuple[Column, int]:
    """The group of a memory, by length class, then by hash into as many groups as the class needs, and the tasks to deal them to."""
    spark = documents.sparkSession
    size_class = F.floor(F.log2(F.col("n_tokens") + 1) * 2).cast("int")
    # One row per class: a few dozen.
    counts = documents.groupBy(size_class.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).collect()
    sizes = {r["c"]: max(-(-r["n"] // GROUP), -(-r["tokens"] // GROUP_TOKENS)) for r in counts} or {0: 1}
    total = sum(r["tokens"] for r in counts)
    tasks = max(-(-total // TASK_TOKENS), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_TOKENS)), 1)
    of_class = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, n)])
    return F.xxhash64(F.lit(label), size_class, F.pmod(F.xxhash64("mem_id"), F.try_element_at(of_class, size_class))), tasks


def block_rows(found: DataFrame) -> DataFrame:
    """Rows (stem, grp, n, n_by_column, entries) of `inversion.blocks` with their impacts.

    All of it is row by row: no list is longer than its group.
    """
    def frequency(e: Column) -> Column:
        return sum((e[f"f{i}"] for i in range(1, _N_COLUMNS)), e["f0"])

    start = F.array().cast("array<struct<f:int,size:int>>")
    pairs = F.sort_array(F.transform("entries", lambda e: F.struct(e["n_tokens"].alias("size"), (-frequency(e)).alias("less"))))
    # Shortest first, then most frequent: a pair counts if it is more frequent than all shorter ones.
    impacts = F.aggregate(pairs, start, lambda kept, p: F.when(
        F.coalesce(F.try_element_at(kept, F.lit(-1))["f"], F.lit(0)) < -p["less"],
        F.concat(kept, F.array(F.struct((-p["less"]).cast("int").alias("f"), p["size"].cast("int").alias("size"))))).otherwise(kept))
    only = F.col("entries")[0]
    single = F.array(F.struct(frequency(only).cast("int").alias("f"), only["n_tokens"].cast("int").alias("size")))
    return found.select("stem", "grp", "n", "n_by_column", F.when(F.col("n") == 1, single).otherwise(impacts).alias("impacts"), "entries")


def _heads(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, unit, wanted, grp, n, impacts) of all blocks of the asked stems; entries are not read."""
    names = F.array(*[F.lit(name) for name in COLUMNS])
    place = F.array_position(names, F.col("col")).cast("int")
    counted = F.when(F.col("col").isNull(), F.col("n")).otherwise(F.coalesce(F.get("n_by_column", place - 1), F.lit(0)))
    found = blocks.select("bucket", "stem", "grp", "n", "n_by_column", "impacts").join(asked, ["bucket", "stem"])
    return found.select("query_id", "unit", "wanted", "grp", counted.cast("long").alias("n"), "impacts").filter("n > 0")


def idf_of(n: Column, n_docs: Column) -> Column:
    idf = F.log((n_docs - n + 0.5) / (n + 0.5))
    return F.when(idf <= 0, F.lit(rules.BM25_LEAST_IDF)).otherwise(idf)


def part_of(idf: Column, f: Column, size: Column, avg_size: Column) -> Column:
    """One unit's part of a rank; lower is better."""
    k1, b = rules.BM25_K1, rules.BM25_B
    return -idf * f * (k1 + 1) / (f + k1 * (1 - b + b * size / avg_size))


def occurrences(blocks: DataFrame, asked: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """query_id, unit, wanted, mem_id, n_tokens, f, in_scope of the blocks' entries that asked rows meet by keys.

    f counts the asked column only, if one is named. extra columns of asked are passed on.
    """
    e = F.col("e")
    f = F.when(F.col("col").isNull(), sum((e[f"f{i}"] for i in range(1, _N_COLUMNS)), e["f0"]))
    for i, name in enumerate(COLUMNS):
        f = f.when(F.col("col") == name, e[f"f{i}"])
    in_scope = (F.col("project").isNull() | F.coalesce(F.col("project") == e["project"], F.lit(False))) & (
        F.col("category").isNull() | (F.col("category") == e["category"]))
    entries = blocks.select("bucket", "stem", "grp", "entries").join(asked, keys).withColumn("e", F.explode("entries"))
    return entries.select(
        "query_id", "unit", "wanted", e["mem_id"].alias("mem_id"), e["n_tokens"].alias("n_tokens"), f.cast("long").alias("f"),
        in_scope.alias("in_scope"), *(extra or [])).filter("f > 0")


def _scores(blocks: DataFrame, asked: DataFrame, pairs: DataFrame, counts: DataFrame, wanted_units: DataFrame, n_docs: Column, avg_size: Column) -> DataFrame:
    """query_id, mem_id, _rank of the memories of the given (query_id, grp) that answer their query."""
    todo = asked.join(counts, ["query_id", "unit"]).join(pairs, "query_id")
    hits = occurrences(blocks, todo, ["bucket", "stem", "grp"], ["n"])
    part = part_of(idf_of(F.col("n"), n_docs), F.col("f"), F.col("n_tokens"), avg_size).cast("decimal(30,15)")
    return (
        hits.groupBy("query_id", "mem_id").agg(
            F.sum(F.when(F.col("wanted") != "none", part)).alias("_rank"), F.count_if(F.col("wanted") == "all").alias("_met"),
            F.count_if(F.col("wanted") == "none").alias("_unwanted"), F.first("in_scope").alias("_in_scope"))
        .join(wanted_units, "query_id", "left")
        .filter(F.col("_in_scope") & (F.col("_unwanted") == 0) & (F.col("_met") == F.coalesce("asked", F.lit(0))))
        .select("query_id", "mem_id", "_rank"))


def best(blocks: DataFrame, asked: DataFrame, known: list[tuple[int, str]] | None, n_docs: Column, avg_size: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, mem_id, _rank) of all memories that may be among the best `limit`, and the candidate groups.

    asked: query_id, unit, wanted, col, project, category, bucket, stem; every unit is one stem. known: their
    (bucket, stem), if they are few, for the scan to skip folders and row groups.
    """
    if known is not None:
        blocks = blocks.filter(F.col("bucket").isin(sorted({b for b, _ in known})) & F.col("stem").isin(sorted({s for _, s in known})))
    heads = stage(_heads(blocks, asked), "block-heads")
    counts = heads.groupBy("query_id", "unit").agg(F.sum("n").alias("n"))
    wanted_units = asked.filter(F.col("wanted") == "all").groupBy("query_id").agg(F.count_distinct("unit").alias("asked"))
    greatest = F.array_max(F.transform("impacts", lambda i: -part_of(idf_of(F.col("total"), n_docs), i["f"], i["size"], avg_size)))
    groups = stage(
        heads.filter("wanted <> 'none'").join(counts.withColumnRenamed("n", "total"), ["query_id", "unit"])
        .groupBy("query_id", "grp").agg(F.sum(greatest).alias("bound"), F.count_if(F.col("wanted") == "all").alias("met"))
        .join(wanted_units, "query_id", "left").filter(F.col("met") >= F.coalesce("asked", F.lit(0)))
        .select("query_id", "grp", "bound")
        .withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "grp"))), "block-groups")
    first = stage(_scores(blocks, asked, groups.filter(F.col("place") <= FIRST_GROUPS).select("query_id", "grp"), counts, wanted_units, n_docs, avg_size), "block-first")
    ranks = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_rank", "mem_id")))
    floors = ranks.filter(F.col("place") == limit).select("query_id", (-F.col("_rank")).cast("double").alias("floor"))
    rest = groups.filter(F.col("place") > FIRST_GROUPS).join(floors, "query_id", "left").filter(
        F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - _SLACK)).select("query_id", "grp")
    return first.unionByName(_scores(blocks, asked, rest, counts, wanted_units, n_docs, avg_size)), rest
