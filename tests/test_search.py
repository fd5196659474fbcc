"""Ranked search against SQLite's full-text index over the same rows."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.functions.analysis import stem, tokens
from tidemark.operators import impacts
from tidemark.operators import search as R
from tidemark.operators import substrings as G
from tidemark.session import shared_path, stage

WORDS = (
    "running runs ran relational relations café cafe naïve config configs configuration how_to data base database "
    "hopping hoped hoping flies fly flying the a of and memory memories committed committing Straße ÉTÉ v1 2024 yes yelled"
).split()


def memory_rows():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        content = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 40)))
        if i % 9 == 0:
            content += " data base of the committed memory, data base"
        category = rng.choice(["fact", "decision", "skill"])
        rows.append((i, category, rng.choice(["how_to", "config"]), content, rng.randrange(1, 11), rng.choice([None, "/home/u/data", "/p"])))
    return rows


@pytest.fixture(scope="module")
def memories(spark):
    return spark.createDataFrame(
        memory_rows(), "mem_id long, category string, subcategory string, content string, importance int, project string"
    ).cache()


@pytest.fixture(scope="module")
def index(memories):
    return R.build_index(memories)


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, category, subcategory, project, tokenize='porter unicode61')")
    for i, category, sub, content, _, project in memory_rows():
        db.execute("INSERT INTO f(rowid, content, category, subcategory, project) VALUES (?,?,?,?,?)", (i + 1, content, category, sub, project or ""))
    return db


QUERIES = [
    # query, mode, column, the same as a match expression
    ("runs hoping", "all", None, "runs hoping"),
    ("fly relation café", "any", None, "fly OR relation OR café"),
    ("how_to", "all", None, "how_to"),
    ("data base", "phrase", None, '"data base"'),
    ("the committed memory", "phrase", None, '"the committed memory"'),
    ("conf", "prefix", None, "conf*"),
    ("run mem", "prefix", None, "run* mem*"),
    ("the flying", "not", None, "the NOT flying"),
    ("config", "all", "subcategory", "subcategory : config"),
    ("data", "all", "content", "content : data"),
    ("été straße", "any", None, "été OR straße"),
    ("fact how_to", "all", None, "fact how_to"),
]


def test_ranks_equal_fts(spark, index, fts):
    queries = spark.createDataFrame(
        [(i, q, mode, col) for i, (q, mode, col, _) in enumerate(QUERIES)], "query_id int, query string, mode string, col string"
    )
    got = {}
    for r in R.ranked(index, queries, limit=1000).collect():
        got.setdefault(r.query_id, {})[r.mem_id] = r.rank
    for i, (*_, match) in enumerate(QUERIES):
        expected = {k - 1: v for k, v in fts.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        assert expected, match
        assert got.get(i, {}).keys() == expected.keys(), match
        assert all(abs(got[i][k] - v) < 1e-9 for k, v in expected.items()), match


def test_filters_come_after_ranking_and_before_the_limit(spark, memories, index):
    schema = "query_id int, query string, mode string, project string, category string"
    free = R.search(memories, spark.createDataFrame([(1, "the", "all", None, None)], schema), 1000, index=index).collect()
    rows = R.search(memories, spark.createDataFrame([(1, "the", "all", "/p", "fact")], schema), 3, index=index).collect()
    expected = sorted((r["rank"], r.mem_id) for r in free if r.project == "/p" and r.category == "fact")[:3]
    assert sorted((r["rank"], r.mem_id) for r in rows) == expected and len(rows) == 3


def test_an_index_can_be_kept(spark, memories, index):
    path = shared_path(spark, "test-index")
    R.build_index(memories, path)
    queries = spark.createDataFrame([(1, "running", "all")], "query_id int, query string, mode string")
    again = R.ranked(R.read_index(spark, path), queries).collect()
    assert again == R.ranked(index, queries).collect() and again


def test_tokens_and_stems_equal_fts(spark):
    words = sorted({w for w in WORDS} | {"ies", "eed", "ss", "yyes", "syzygy", "generalizations", "ate", "at", "controll", "vietnamization", "é" * 70})
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(w, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    db.executemany("INSERT INTO f(rowid, w) VALUES (?, ?)", enumerate(words))
    expected = {}
    for term, doc in db.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        expected.setdefault(words[doc], []).append(term)
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.posexplode(tokens(F.col("w"))).alias("p", "t"))
    got = {}
    for r in df.select("w", "p", stem(F.col("t")).alias("s")).orderBy("w", "p").collect():
        got.setdefault(r.w, []).append(r.s)
    assert got == expected


def test_like(memories):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE m(id, content, importance)")
    db.executemany("INSERT INTO m VALUES (?,?,?)", [(r[0], r[3], r[4]) for r in memory_rows()])
    for text in ("DATA", "o_t", "été", "ru%g", "ÉT", "a\\b"):
        expected = db.execute("SELECT id FROM m WHERE content LIKE ? ORDER BY importance DESC, id LIMIT 10", (f"%{text}%",)).fetchall()
        assert [r.mem_id for r in R.search_like(memories, text).collect()] == [i for (i,) in expected], text


def test_plan_has_no_cross_join(spark, index):
    queries = spark.createDataFrame([(1, "a b", "any")], "query_id int, query string, mode string")
    plan = R.ranked(index, queries)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_unknown_modes_are_refused(spark, index):
    queries = spark.createDataFrame([(1, "a b", "every")], "query_id int, query string, mode string")
    with pytest.raises(Exception, match="unknown search mode"):
        R.ranked(index, queries).collect()


def test_an_index_grows_by_appends(spark, memories, index):
    path = shared_path(spark, "test-index")
    for part in range(3):
        R.append_to_index(memories.filter(F.col("mem_id") % 3 == part), path)
    queries = spark.createDataFrame(
        [(1, "running data", "any"), (2, "con", "prefix"), (3, "data base", "phrase")], "query_id int, query string, mode string")
    assert R.ranked(R.read_index(spark, path), queries).collect() == R.ranked(index, queries).collect()


def test_many_results_are_cut_in_two_steps(spark, index, monkeypatch):
    queries = spark.createDataFrame([(1, "the of data", "any")], "query_id int, query string, mode string")
    plain = R.ranked(index, queries, 20).collect()
    monkeypatch.setattr(R, "_GROUP_LIMIT", 5)
    assert R.ranked(index, queries, 20).collect() == plain


def test_a_search_reads_the_folders_of_its_tokens(spark, index):
    queries = spark.createDataFrame([(1, "running", "all")], "query_id int, query string, mode string")
    asked = R.plan_units(index, stage(R.query_units(queries), "units"))
    assert 0 < len(asked.stem_buckets) < R.BUCKETS and asked.token_buckets == []
    plan = R.unit_counts(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_any_key_will_do(spark, memories):
    renamed = memories.select(F.sha2(F.col("mem_id").cast("string"), 256).alias("commit_hash"), "category", "subcategory", "content", "importance", "project")
    queries = spark.createDataFrame([(1, "running", "all")], "query_id int, query string, mode string")
    hits = R.search(renamed, queries, key="commit_hash").collect()
    assert hits and all("run" in r.content for r in hits)


def test_fallback_takes_queries_without_tokens(spark, memories):
    queries = spark.createDataFrame([(1, "data base", "all"), (2, "!!! data", "all"), (3, "% the", "any")], "query_id int, query string, mode string")
    assert {r.query_id for r in R.fallback_queries(queries).collect()} == {2, 3}
    hits = R.search_like_all(memories, queries, 5)
    for i, text in ((1, "data base"), (2, "!!! data"), (3, "% the")):
        one = [r.mem_id for r in R.search_like(memories, text, limit=5).collect()]
        assert [r.mem_id for r in hits.filter(F.col("query_id") == i).orderBy("place").collect()] == one


def test_substrings_by_trigrams_equal_the_scan(spark):
    texts = ["plain text here", "Text 100% sure", "a_b c", "äöü straße", "x", "", None, "back\\slash", "😀😀 emoji 😀x", "aXtextY", "tex t"] * 3
    rows = [(i, "fact", None, t, i % 7, None if i % 4 else "/p") for i, t in enumerate(texts)]
    memories = spark.createDataFrame(rows, "mem_id long, category string, subcategory string, content string, importance int, project string")
    path = shared_path(spark, "grams")
    for part in range(2):
        G.append_trigrams(memories.filter(F.col("mem_id") % 2 == part), path)
    asked = ["text", "TEXT", "%", "0% s", "a_b", "t%x", "äöü", "straß", "x", "no such thing", "k\\s", "😀😀", "😀 e", "tex_", "ext h"]
    queries = spark.createDataFrame([(i, q, "all", "/p" if i % 3 == 2 else None) for i, q in enumerate(asked)], "query_id int, query string, mode string, project string")
    order = ["query_id", "place"]
    scan = R.search_like_all(memories, queries, 5).orderBy(*order).collect()
    assert R.search_like_all(memories, queries, 5, grams=G.read_trigrams(spark, path)).orderBy(*order).collect() == scan
    assert {r.query_id for r in scan} >= {0, 1, 2, 3, 4, 5, 7, 11}
    assert R.search_like_all(memories, queries.limit(0), grams=G.read_trigrams(spark, path)).collect() == []


def test_indexed_substrings_carry_no_queries_over_memories(spark, memories):
    queries = spark.createDataFrame([(1, "data-base", "all"), (2, "!!! memory", "any")], "query_id int, query string, mode string")
    plan = R.search_like_all(memories, queries, grams=G.build_trigrams(memories))._jdf.queryExecution().optimizedPlan().toString()
    assert "_all" not in plan and "collect_list" not in plan


def test_routing(spark, memories, index):
    queries = spark.createDataFrame(
        [(1, "running data", "all"), (2, "data !!!", "all"), (3, "data-base", "any"), (4, "data, base", "phrase"), (5, "memory, data", "all"), (6, "café", "all")],
        "query_id int, query string, mode string")
    assert {r.query_id for r in R.fallback_queries(queries).collect()} == {2, 3, 5}
    assert {r.query_id for r in R.search(memories, queries, index=index).collect()} == {1, 4, 6}
    routed = R.search_routed(memories, queries, index=index, grams=G.build_trigrams(memories)).collect()
    assert {r.query_id for r in routed} == {1, 4, 5, 6}
    assert all(r["rank"] == 0 and "memory, data" in r.content for r in routed if r.query_id == 5)


def test_blocks_below_the_floor_are_not_scored(spark, monkeypatch):
    """A rare word that some short memories repeat: only a few groups can reach the tenth best."""
    monkeypatch.setattr(impacts, "GROUP", 16)
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        words = [rng.choice(WORDS) for _ in range(5 if i % 100 == 0 else rng.randrange(20, 200))]
        rows.append((i, "fact", "x", " ".join(words + (["zeta"] * (6 if i % 100 == 0 else 1) if i % 5 == 0 else [])), 1, None))
    memories = spark.createDataFrame(rows, "mem_id long, category string, subcategory string, content string, importance int, project string")
    index = R.build_index(memories)
    queries = spark.createDataFrame([(1, "zeta", "all"), (2, "zeta running", "any")], "query_id int, query string, mode string")
    units = R.query_units(queries).withColumn("bucket", R.bucket_of(F.col("stem")))
    total, size = R.corpus_stats(index.sizes).first()
    _, rest = impacts.best(index.blocks, units, None, F.lit(total), F.lit(size / total), 10)
    groups = index.blocks.filter("stem = 'zeta'").count()
    later = {r.query_id: r["count"] for r in rest.groupBy("query_id").count().collect()}
    assert groups > 60 and later.get(1, 0) < groups / 4
    # The same answers as from the positions.
    plain = R._positional(index, R.query_units(queries), F.lit(total), F.lit(size / total)).collect()
    for q in (1, 2):
        want = sorted((r["_rank"], r.mem_id) for r in plain if r.query_id == q)[:10]
        assert [(r.mem_id) for r in R.ranked(index, queries).filter(F.col("query_id") == q).orderBy("place").collect()] == [m for _, m in want]
