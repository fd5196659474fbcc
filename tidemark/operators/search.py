"""Full-text retrieval.

The index is stored: postings (one row per token, memory and column, sorted by token in folders by
token hash), a vocabulary (one row per distinct token with its stem), the memories' token counts, and
impact blocks (one row per stem and group of memories, see `impacts`). Queries of single words are
answered from the blocks. Those with a phrase or a prefix are turned into the tokens that can satisfy
them, by joining their stems with the vocabulary; then only the folders of those tokens are read. Nothing
but the vocabulary is ever stemmed. New memories are appended (`append_to_index`).

Queries come as a table: query_id, query (words), mode, and optionally col, project, category.
Modes: all, any, phrase, prefix (all words, each the beginning of a token), not (the first word
without the others). col keeps matches to one column. No query language is parsed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import rules
from tidemark.functions.analysis import stem as stem_of
from tidemark.functions.analysis import tokens
from tidemark.functions.text import ascii_lower
from tidemark.operators import impacts, inversion, substrings
from tidemark.session import shared_path, stage, staging

COLUMNS = impacts.COLUMNS
MODES = ["all", "any", "phrase", "prefix", "not"]
BUCKETS = 32
# Above this many results per query Spark no longer cuts groups before their shuffle.
_GROUP_LIMIT = 1_000
_PARTS = 64
_POS_SPAN = 1 << 40  # more than any column has tokens


@dataclass
class MemoryIndex:
    """postings: bucket, token, mem_id, no, positions, n_tokens, project, category (a row per memory, equal ids too).
    vocabulary: token, stem (a token may repeat after an append). sizes: mem_id, n_tokens.
    blocks: bucket, stem, grp, n, n_by_column, impacts, entries."""

    postings: DataFrame
    vocabulary: DataFrame
    sizes: DataFrame
    blocks: DataFrame


def analysed(memories: DataFrame, key: str = "mem_id") -> DataFrame:
    """Token arrays of each memory's four columns."""
    arrays = {f"_{name}": tokens(F.col(name)) for name in COLUMNS}
    split = memories.select(F.col(key).alias("mem_id"), "project", "category", *[c.alias(n) for n, c in arrays.items()])
    return split.withColumn("n_tokens", sum((F.size(n) for n in arrays), F.lit(0)))


def vocabulary_of(documents: DataFrame, stem: bool = True) -> DataFrame:
    """Distinct tokens with their stems (the token itself without stemming).

    Tokens are made distinct within each memory first, then map-side, so a token found in every
    memory reaches the shuffle once per task.
    """
    all_tokens = F.array_distinct(F.concat(*[f"_{name}" for name in COLUMNS]))
    words = documents.select(F.explode(all_tokens).alias("token")).distinct()
    return words.withColumn("stem", stem_of(F.col("token")) if stem else F.col("token"))


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def append_to_index(memories: DataFrame, path: str, stem: bool = True, key: str = "mem_id") -> None:
    """Add memories that the index does not hold yet. One writer per index.

    Token lists are written once and read by each part of the index; they are deleted at the end. Postings and
    blocks are made where their memories were dealt to and written from there, a file per task and folder,
    sorted by token or stem within it: only the memories are shuffled, not their occurrences.
    """
    with staging(memories.sparkSession):
        documents = stage(analysed(memories, key), "analysed")
        group, tasks = impacts.group_of(documents, uuid.uuid4().hex)
        dealt = inversion.dealt(documents, group, tasks)
        postings = inversion.postings(dealt).withColumn("bucket", bucket_of(F.col("token")))
        postings.sortWithinPartitions("bucket", "token").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
        blocks = impacts.block_rows(inversion.blocks(dealt, stem_of if stem else lambda token: token)).withColumn("bucket", bucket_of(F.col("stem")))
        blocks.sortWithinPartitions("bucket", "stem").write.mode("append").partitionBy("bucket").parquet(f"{path}/blocks")
        vocabulary_of(documents, stem).sortWithinPartitions("stem").write.mode("append").parquet(f"{path}/vocabulary")
        documents.select("mem_id", "n_tokens").write.mode("append").parquet(f"{path}/sizes")


def build_index(memories: DataFrame, path: str | None = None, stem: bool = True, key: str = "mem_id") -> MemoryIndex:
    """Analyse the memories once and store the index, in the shared folder if no path is given."""
    spark = memories.sparkSession
    path = path or shared_path(spark, "index")
    append_to_index(memories, path, stem, key)
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> MemoryIndex:
    return MemoryIndex(*[spark.read.parquet(f"{path}/{part}") for part in ("postings", "vocabulary", "sizes", "blocks")])


def corpus_stats(documents: DataFrame) -> DataFrame:
    """Number of memories and of tokens."""
    return documents.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def term_frequencies(documents: DataFrame) -> DataFrame:
    """Per token the number of memories it occurs in.

    Each memory counts a token once, inside its own row; the rest is a map-side combined count.
    """
    all_tokens = F.array_distinct(F.concat(*[f"_{name}" for name in COLUMNS]))
    return documents.select(F.explode(all_tokens).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("memories")
    )


def query_units(queries: DataFrame, stem: bool = True) -> DataFrame:
    """Queries as units: query_id, unit, wanted (all, any, none), offset, n_terms, prefix, stem.

    A unit is a word, or a whole phrase. A word that splits into several tokens (how_to) is a
    phrase of its own. Only the last token of a prefix unit is matched by its beginning.
    """
    have = set(queries.columns)
    optional = {
        c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("col", "project", "category")
    }
    words = F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != "")
    unit_texts = F.when(F.col("mode") == "phrase", F.array("query")).otherwise(words)
    known = F.when(F.col("mode").isin(MODES), F.col("mode")).otherwise(F.raise_error(F.lit("unknown search mode")).cast("string"))
    units = queries.withColumn("mode", known).select("query_id", "mode", *optional.values(), F.posexplode(unit_texts).alias("unit", "_text"))
    units = units.withColumn("_tokens", tokens(F.col("_text"))).withColumn("n_terms", F.size("_tokens"))
    terms = units.select(
        "query_id", "unit", "mode", "col", "project", "category", "n_terms",
        F.posexplode("_tokens").alias("offset", "token"),
    )
    terms = terms.withColumn("stem", stem_of(F.col("token")) if stem else F.col("token"))
    wanted = (
        F.when(F.col("mode") == "any", "any")
        .when((F.col("mode") == "not") & (F.col("unit") > 0), "none")
        .otherwise("all")
    )
    return terms.select(
        "query_id", "unit", wanted.alias("wanted"), "col", "project", "category", "n_terms", "offset",
        ((F.col("mode") == "prefix") & (F.col("offset") == F.col("n_terms") - 1)).alias("prefix"),
        "stem",
    )


@dataclass
class QueryPlan:
    """Query units, written once; what satisfies them (stems of single words, tokens of phrases); the folders of both."""

    units: DataFrame
    found: DataFrame
    stem_buckets: list[int]
    token_buckets: list[int]


def plan_units(index: MemoryIndex, units: DataFrame) -> QueryPlan:
    """Written units and the corpus stems or tokens that satisfy them, written to the shared folder too.

    An equality join on stems, and for prefixes one on the beginnings of stems, of just the lengths
    that are asked for. Written tables have a known size: the planner broadcasts them in later
    joins only below its threshold.
    """
    prefixes = units.filter("prefix")
    asked = prefixes.select(F.array_sort(F.collect_set(F.length("stem")))).scalar()
    begun = (
        index.vocabulary.select("token", F.col("stem").alias("_stem"), asked.alias("_asked"))
        .select("token", "_stem", F.explode(F.filter("_asked", lambda n: n <= F.length("_stem"))).alias("_len"))
        .select("token", "_stem", F.substr("_stem", F.lit(1), F.col("_len")).alias("stem"))
    )
    phrases = units.filter((F.col("n_terms") > 1) & ~F.col("prefix")).join(index.vocabulary, "stem")
    words = units.filter((F.col("n_terms") == 1) & ~F.col("prefix"))
    begun_units = prefixes.join(begun, "stem")
    single = F.col("n_terms") == 1
    # A token may stand in the vocabulary once per append; it is made distinct after the joins have cut it.
    found = (
        phrases.withColumnRenamed("token", "term")
        .unionByName(words.withColumn("term", F.col("stem")))
        .unionByName(begun_units.withColumn("term", F.when(single, F.col("_stem")).otherwise(F.col("token"))).drop("token", "_stem"))
        .distinct())
    wanted = stage(found.withColumn("bucket", bucket_of(F.col("term"))), "query-terms")
    # At most 2 * BUCKETS rows: they let the scans of the index pass over the other folders.
    rows = wanted.select(single.alias("single"), "bucket").distinct().collect()
    return QueryPlan(units, wanted, [r["bucket"] for r in rows if r["single"]], [r["bucket"] for r in rows if not r["single"]])


def unit_counts(index: MemoryIndex, plan: QueryPlan) -> DataFrame:
    """Occurrences of each query unit in each memory: query_id, mem_id, unit, f.

    Single words are counted from the blocks of their stems, phrases from the postings. A phrase occurs
    where its tokens stand in a row within one column, that is where their positions less their
    offsets agree: counting those needs no self-join. Hits combine map-side, as all hits of a
    memory come from its own row.
    """
    keys = ["query_id", "mem_id", "unit", "wanted"]
    counts = []
    if plan.stem_buckets:
        words = plan.found.filter("n_terms = 1").select("query_id", "unit", "wanted", "col", "project", "category", "bucket", F.col("term").alias("stem"))
        counts.append(impacts.occurrences(index.blocks.filter(F.col("bucket").isin(plan.stem_buckets)), words, ["bucket", "stem"]).groupBy(*keys).agg(
            F.sum("f").alias("f"), F.first("n_tokens").alias("n_tokens"), F.first("in_scope").alias("in_scope")))
    if plan.token_buckets or not counts:
        counts.append(_phrase_counts(index, plan).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("f"), F.first("n_tokens").alias("n_tokens"), F.first("in_scope").alias("in_scope")))
    return counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])


def _phrase_counts(index: MemoryIndex, plan: QueryPlan) -> DataFrame:
    """One row per place at which a whole phrase stands."""
    names = F.array(*[F.lit(name) for name in COLUMNS])
    postings = index.postings.filter(F.col("bucket").isin(plan.token_buckets)).select(
        "bucket", "token", "mem_id", "n_tokens", F.col("project").alias("_project"), F.col("category").alias("_category"),
        "no", "positions")
    terms = plan.found.filter("n_terms > 1").withColumnRenamed("term", "token")
    hits = postings.join(terms, ["bucket", "token"]).filter(
        F.col("col").isNull() | (F.col("col") == F.get(names, F.col("no")))
    ).withColumn("pos", F.explode("positions"))
    in_scope = (F.col("project").isNull() | F.coalesce(F.col("project") == F.col("_project"), F.lit(False))) & (
        F.col("category").isNull() | (F.col("category") == F.col("_category"))
    )
    start = F.col("no").cast("long") * _POS_SPAN + F.col("pos") - F.col("offset")
    return (
        hits.groupBy("query_id", "mem_id", "unit", "wanted", "n_terms", start.alias("_start"))
        .agg(F.count(F.lit(1)).alias("_n"), F.first("n_tokens").alias("n_tokens"), F.bool_and(in_scope).alias("in_scope"))
        .filter(F.col("_n") == F.col("n_terms"))
    )


def _positional(index: MemoryIndex, units: DataFrame, n_docs: Column, avg_size: Column) -> DataFrame:
    """query_id, mem_id, _rank of all memories that answer, from the postings with positions."""
    plan = plan_units(index, units)
    # Read twice, for the document counts and for the scores: written once, so that the corpus is
    # scanned once. Only matches get here.
    counts = stage(unit_counts(index, plan), "unit-counts")
    asked = plan.units.filter(F.col("wanted") == "all").groupBy("query_id").agg(F.count_distinct("unit").alias("asked"))
    found = counts.groupBy("query_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    part = impacts.part_of(impacts.idf_of(F.col("n"), n_docs), F.col("f"), F.col("n_tokens"), avg_size).cast("decimal(30,15)")
    scores = (
        counts.join(found, ["query_id", "unit"])
        .groupBy("query_id", "mem_id")
        .agg(
            F.sum(F.when(F.col("wanted") != "none", part)).alias("_rank"),
            F.count_if(F.col("wanted") == "all").alias("_met"),
            F.count_if(F.col("wanted") == "none").alias("_unwanted"),
            F.first("in_scope").alias("_in_scope"),
        )
        .join(asked, "query_id", "left")
        .filter(F.col("_in_scope") & (F.col("_unwanted") == 0) & (F.col("_met") == F.coalesce("asked", F.lit(0))))
    )
    return scores.select("query_id", "mem_id", "_rank")


def ranked(index: MemoryIndex, queries: DataFrame, limit: int = 10, stem: bool = True) -> DataFrame:
    """The best memories of each query: query_id, mem_id, rank (lower is better).

    Document counts and mean length are those of the whole table; project and category only
    choose among the ranked. Contributions are summed as exact decimals, so equal memories tie
    whatever order they meet in, and ties go by mem_id.
    """
    simple = F.bool_and((F.col("n_terms") == 1) & ~F.col("prefix")).over(Window.partitionBy("query_id"))
    units = stage(query_units(queries, stem).withColumn("simple", simple).withColumn("bucket", bucket_of(F.col("stem"))), "query-units")
    total, size = corpus_stats(index.sizes).first()
    n_docs, avg_size = F.lit(total), F.lit(size / total if total else None).cast("double")
    # One more than the literals the scan takes: then the number itself does not matter any more.
    asked = units.select("simple", "bucket", "stem").distinct().limit(impacts.LITERALS + 1).collect()
    found = []
    if len(asked) > impacts.LITERALS or any(row["simple"] for row in asked):
        known = [(row["bucket"], row["stem"]) for row in asked if row["simple"]] if len(asked) <= impacts.LITERALS else None
        found.append(impacts.best(index.blocks, units.filter("simple"), known, n_docs, avg_size, limit)[0])
    if len(asked) > impacts.LITERALS or not all(row["simple"] for row in asked) or not found:
        found.append(_positional(index, units.filter("not simple").drop("simple", "bucket"), n_docs, avg_size))
    scores = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    best = Window.partitionBy("query_id").orderBy("_rank", "mem_id")
    if limit > _GROUP_LIMIT:
        # Two steps: the best of each part of a query's matches, then the best of those.
        part_of = Window.partitionBy("query_id", F.pmod(F.xxhash64("mem_id"), F.lit(_PARTS))).orderBy("_rank", "mem_id")
        scores = scores.withColumn("place", F.row_number().over(part_of)).filter(F.col("place") <= limit).drop("place")
    return (
        scores.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= limit)
        .select("query_id", "mem_id", "place", F.col("_rank").cast("double").alias("rank"))
    )


def search(
    memories: DataFrame, queries: DataFrame, limit: int = 10, stem: bool = True, index: MemoryIndex | None = None,
    key: str = "mem_id",
) -> DataFrame:
    """Ranked memories with their columns; access_count is the one before the touch.

    key names the memories' own key: mem_id, or commit_hash for a store that jobs have written.
    Queries that the index cannot answer (`needs_scan`) have no rows here; `search_routed` answers them too.
    """
    # Queries times limit rows, written once: broadcast to the memories while that is small.
    hits = stage(ranked(index or build_index(memories, stem=stem, key=key), queries.filter(~needs_scan()), limit, stem), "hits")
    return memories.join(hits.withColumnRenamed("mem_id", key), key)


def search_routed(
    memories: DataFrame, queries: DataFrame, limit: int = 10, stem: bool = True, index: MemoryIndex | None = None,
    grams: DataFrame | None = None, key: str = "mem_id",
) -> DataFrame:
    """R2 with R4: each query by the index if that can answer it, else as a substring with rank 0."""
    found = search(memories, queries, limit, stem, index, key)
    return found.unionByName(search_like_all(memories, fallback_queries(queries), limit, key, grams).select(*found.columns))


def needs_scan() -> Column:
    """Whether the index cannot answer a query (columns query, mode): a word without a token, or one that
    holds an ASCII sign besides letters, digits and underscore. A phrase is taken as it is."""
    words = F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != "")
    odd = F.exists(words, lambda w: w.rlike(r"[\x01-\x7f&&[^A-Za-z0-9_]]") | (F.size(tokens(w)) == 0))
    return (F.col("mode") != "phrase") & odd


def fallback_queries(queries: DataFrame) -> DataFrame:
    """The queries that the index cannot answer, such as '!!!' or 'data-base'; they go to search_like_all."""
    return queries.filter(needs_scan())


def search_like_all(memories: DataFrame, queries: DataFrame, limit: int = 10, key: str = "mem_id", grams: DataFrame | None = None) -> DataFrame:
    """R4 for a table of queries (query_id, query, optionally project and category).

    Each query is a text to find as in search_like, most important memories first; each keeps its best
    rows per part of the memories before they meet. With a trigram index (grams) only memories that
    hold a query's rarest trigrams are read against it. Queries without a trigram, or all without an
    index, are tested against each memory, as one array of stated queries.
    """
    have = set(queries.columns)
    optional = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(f"_{c}") for c in ("project", "category")]
    asked = stage(queries.select("query_id", F.col("query").alias("_query"), *optional), "like-queries")
    indexed = F.size(substrings.pattern_trigrams(F.col("_query"))) > 0 if grams is not None else F.lit(False)
    kinds = {row[0] for row in asked.select(indexed).distinct().collect()}
    text = ascii_lower(F.col("content"))

    def pattern_of(query: Column) -> Column:
        return F.concat(F.lit("%"), F.replace(ascii_lower(query), F.lit("\\"), F.lit("\\\\")), F.lit("%"))

    found = []
    if True in kinds:
        by_gram = asked.filter(indexed)
        pairs = substrings.candidates(grams, by_gram).join(by_gram, "query_id").withColumnRenamed("mem_id", key)
        found.append(memories.join(pairs, key).filter(F.like(text, pattern_of(F.col("_query")))))
    if False in kinds or not kinds:
        scanned = asked.filter(~indexed)
        table = scanned.agg(F.collect_list(F.struct("query_id", "_query", "_project", "_category"))).scalar()  # the stated query set
        found.append(
            memories.withColumn("_all", table)
            .withColumn("_q", F.explode(F.filter("_all", lambda q: F.like(text, pattern_of(q["_query"])))))
            .select(*memories.columns, "_q.*"))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    rows = (
        rows.filter(F.col("_project").isNull() | (F.col("_project") == F.col("project")))
        .filter(F.col("_category").isNull() | (F.col("_category") == F.col("category")))
        .select("query_id", *memories.columns))
    part_of = Window.partitionBy("query_id", F.pmod(F.xxhash64(key), F.lit(_PARTS))).orderBy(F.desc("importance"), key)
    best = Window.partitionBy("query_id").orderBy(F.desc("importance"), key)
    return (
        rows.withColumn("place", F.row_number().over(part_of)).filter(F.col("place") <= limit)
        .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
        .withColumn("rank", F.lit(0.0))
    )


def search_like(
    memories: DataFrame, text: str, project: str | None = None, category: str | None = None, limit: int = 10,
    key: str = "mem_id",
) -> DataFrame:
    """Memories that contain text, most important first; rank is 0.

    As in SQL LIKE, % and _ in text are wildcards and only A-Z match in either case.
    """
    found = memories
    if project:
        found = found.filter(F.col("project") == project)
    if category:
        found = found.filter(F.col("category") == category)
    # LIKE has no escape sign here, so a backslash must stand for itself.
    wanted = "%" + text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) + "%"
    return (
        found.filter(ascii_lower(F.col("content")).like(wanted.replace("\\", "\\\\")))
        .orderBy(F.desc("importance"), key)
        .limit(limit)
        .withColumn("rank", F.lit(0.0))
    )
