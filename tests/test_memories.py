import json

from pyspark.sql import functions as F

from tidemark.functions.memory import json_array_text, json_items
from tidemark.functions.text import with_json
from tidemark.operators import extraction as E
from tidemark.operators import memories as M
from tidemark.plans.jobs import commit_outputs, new_to_store
from tidemark.session import shared_path
from tidemark.sources.known import append_filter, level_for, may_know, read_filters
from tidemark.sources.sinks import append_memories, filter_path, read_commits, read_memories

SCHEMA = "run_id string, run_part int, category string, context_length long, output string"


def python_items(text):
    text = text.strip()
    if text.startswith("```"):
        lines = text.split("\n")
        ends = [i for i in range(1, len(lines)) if lines[i].strip().startswith("```")]
        text = "\n".join(lines[1:ends[-1] if ends else len(lines)]).strip()
    a, b = text.find("["), text.rfind("]")
    if a == -1 or b <= a:
        return 0
    try:
        return len(json.loads(text[a:b + 1]))
    except json.JSONDecodeError:
        return 0


OUTPUTS = [
    "", "[]", "no array", "[1,2", "] [", 'x [1, "a]b"] y', "```json\n[1]\n```", "```\n[1]\n``` trailing ]", "```[1]```",
    "``` \n[1,2]\n  ```\nmore\n```\nrest", "```\n[1]", '[{"a":1,"a":2}]', "[[1],[2]]", '{"k":[1,2,3]}', "[1] and [2]", "[null]", "[1], [2]", "[1]], [[2]",
]


def test_array_parsing(spark):
    df = with_json(spark.createDataFrame([(o,) for o in OUTPUTS], "o string"), json_array_text(F.col("o")), "a")
    df = df.select("o", F.size(json_items(F.col("a"))).alias("n"))
    assert {r.o: r.n for r in df.collect()} == {o: python_items(o) for o in OUTPUTS}


def items_of(spark, *objects, category="fact"):
    output = json.dumps(list(objects))
    read = E.read_outputs(spark.createDataFrame([("r", 0, category, 1, output)], SCHEMA)).first()
    return None if read["items"] is None else [(i.pos, i.content, i.importance, i.subcategory) for i in read["items"]]


def test_item_rules(spark):
    assert items_of(spark, 3, "x", None, {"text": " a "}, {"importance": 9}, {"text": "  ", "importance": "bad"}) == [(3, "a", 5, "reference")]
    good = [8.7, "7", " +7 ", "1_0", True, -2.9]
    assert [i[2] for i in items_of(spark, *[{"text": "t", "importance": g} for g in good])] == [8, 7, 7, 10, 1, -2]
    for bad in ("8.7", "high", None, [1], {"a": 1}, ""):
        assert items_of(spark, {"text": "t", "importance": bad}, {"text": "lost"}) is None
    for bad in (5, None, ["t"]):
        assert items_of(spark, {"text": bad}) is None
    assert items_of(spark, {"text": "t", "subcategory": None}, category="skill") == [(0, "t", 5, "how_to")]


def test_failed_extractor_leaves_the_others(spark):
    rows = [("r", 0, "fact", 9, '[{"text":"x","importance":"no"}]'), ("r", 0, "skill", 9, '[{"text":"y","importance":9}]')]
    outputs = spark.createDataFrame(rows, SCHEMA)
    assert [r.content for r in E.parsed_items(outputs).collect()] == ["y"]
    assert [r.category for r in E.failed_outputs(outputs).collect()] == ["fact"]


def test_commit_is_idempotent_and_first_wins(spark):
    path = shared_path(spark, "test-store")
    rows = [(f"r{i}", 0, "fact", 200, '[{"text":"same","importance":%d},{"text":"own %d","importance":7}]' % (9 - i % 2, i)) for i in range(30)]
    outputs = spark.createDataFrame(rows, SCHEMA)
    first = commit_outputs(outputs, path, path + "-runs")
    assert first.count() == 31
    assert first.filter("content = 'same'").first().run_id == "r0"
    assert commit_outputs(outputs, path, path + "-runs").count() == 0
    more = spark.createDataFrame([("z", 0, "fact", 1, '[{"text":"same","importance":9},{"text":"new","importance":9},{"text":"low","importance":6}]')], SCHEMA)
    assert [r.content for r in commit_outputs(more, path).collect()] == ["new"]
    assert read_memories(spark, path).count() == 32
    runs = spark.read.parquet(path + "-runs")
    assert runs.filter("run_id = 'r0/0'").agg(F.sum("extracted"), F.sum("committed")).first() == (2, 2)


def test_touch(spark):
    memories = spark.createDataFrame([(1, 4), (2, 0)], "mem_id int, access_count int").withColumn("accessed_at", F.lit(None).cast("timestamp"))
    hits = spark.createDataFrame([(10, 1), (11, 1)], "query_id int, mem_id int")
    got = {r.mem_id: r for r in M.touched(memories, hits, at=F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got[1].access_count == 6 and got[1].accessed_at is not None
    assert got[2].access_count == 0 and got[2].accessed_at is None


def test_unassigned_project(spark):
    memories = spark.createDataFrame([(None, "fact"), (None, "fact"), ("/p", "skill")], "project string, category string")
    assert [tuple(r) for r in M.top_projects(memories).collect()] == [("unassigned", 2), ("/p", 1)]
    assert {(r.section, r.name): r.memories for r in M.memory_stats(memories).collect()} == {
        ("total", "all"): 3, ("category", "fact"): 2, ("category", "skill"): 1,
    }


def test_copies_combine_before_the_shuffle(spark):
    items = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("content"),
        F.lit("fact").alias("category"), F.lit("reference").alias("subcategory"), F.lit(9).cast("long").alias("importance"),
        F.col("id").alias("run_id"), F.lit(0).alias("run_part"), F.lit(1).alias("cat_order"), F.lit(0).alias("pos"),
    )
    kept = M.committed_memories(items)
    assert kept.count() == 667 and kept.filter("content = 'hot'").first().run_id == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan


def hashes(spark, start, stop):
    return spark.range(start, stop).select(F.sha2(F.col("id").cast("string"), 256).alias("commit_hash"))


def test_filter_names_every_commit_that_knows_a_hash(spark):
    path = shared_path(spark, "test-known")
    sizes = {"a": (0, 1), "b": (0, 1000), "c": (500, 40_000)}
    for name, (start, stop) in sizes.items():
        append_filter(hashes(spark, start, stop), path, name)
    append_filter(hashes(spark, 0, 0), path, "empty")
    filters = read_filters(spark, path)
    assert {(r.added, r.level) for r in filters.select("added", "level").distinct().collect()} == {(n, level_for(b - a)) for n, (a, b) in sizes.items()}
    for name, (start, stop) in sizes.items():
        named = may_know(hashes(spark, 0, 60_000), filters).where(F.col("added") == name).select("commit_hash")
        assert hashes(spark, start, stop).join(named, "commit_hash", "left_anti").count() == 0
        assert named.count() - (stop - start) < 60  # falsely named, of 60,000


def test_level_has_the_bits_it_promises():
    for n in (1, 1365, 1366, 2731, 10**6, 10**10):
        assert 2 ** level_for(n) * 32768 >= 24 * n
        assert level_for(n) == 0 or 2 ** (level_for(n) - 1) * 32768 < 24 * n


def test_commit_reads_only_commits_that_may_know_a_hash(spark):
    path = shared_path(spark, "test-pruned")
    for i in range(6):
        rows = hashes(spark, i * 100, i * 100 + 100).withColumns({
            "category": F.lit("fact"), "subcategory": F.lit("x"), "content": F.lit("y"), "importance": F.lit(9)})
        append_memories(rows, path)
    batch = hashes(spark, 250, 280).union(hashes(spark, 10_000, 10_030))
    new = new_to_store(batch, read_commits(spark, path), read_filters(spark, filter_path(path)))
    assert {r[0] for r in new.collect()} == {r[0] for r in hashes(spark, 10_000, 10_030).collect()}
    plan = new._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    found = read_commits(spark, path).join(may_know(batch, read_filters(spark, filter_path(path))), ["added", "commit_hash"], "left_semi")
    assert found.select("added").distinct().count() == 1 and found.count() == 30
