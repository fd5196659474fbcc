"""How the search indexes are built: what is shuffled, what stays behind, and repeated or missing keys."""

import os

from pyspark.sql import functions as F

from tidemark.operators import impacts, inversion
from tidemark.operators import search as R
from tidemark.operators import substrings as G
from tidemark.session import shared_folder, shared_path

SCHEMA = "mem_id long, category string, subcategory string, content string, importance int, project string"


def test_occurrences_are_not_shuffled(spark):
    memories = spark.createDataFrame([(i, "fact", "x", f"running runs word{i}", 1, None) for i in range(20)], SCHEMA)
    documents = R.analysed(memories)
    dealt = inversion.dealt(documents, *impacts.group_of(documents, "t"))
    for made in (inversion.postings(dealt), impacts.block_rows(inversion.blocks(dealt, R.stem_of))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Join" not in plan


def test_an_index_leaves_nothing_staged(spark):
    memories = spark.createDataFrame([(1, "fact", "x", "some words", 1, None)], SCHEMA)
    folder = f"{shared_folder(spark)}/tidemark"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    R.build_index(memories, shared_path(spark, "left-index"))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"left-index"}


def test_equal_and_missing_keys_share_one_entry(spark):
    rows = [(1, "fact", "x", "run runs zeta", 1, "/p"), (1, "fact", "x", "run runs zeta", 1, "/p"), (None, "fact", "x", "zeta", 1, None), (3, None, None, "", 1, None)]
    index = R.build_index(spark.createDataFrame(rows, SCHEMA))
    entries = {(r.stem, r.mem_id): (r.f0, r.n_tokens) for r in index.blocks.select("stem", F.inline("entries")).collect()}
    assert entries[("run", 1)] == (4, 6) and entries[("zeta", 1)] == (2, 6) and entries[("zeta", None)] == (1, 3)
    block = index.blocks.filter("stem = 'run'").first()
    assert (block.n, list(block.n_by_column)) == (1, [1, 0, 0, 0]) and [tuple(i) for i in block.impacts] == [(4, 6)]
    assert index.sizes.count() == 4
    positions = sorted(r.positions for r in index.postings.filter("token = 'runs' and mem_id = 1").collect())
    assert positions == [[1], [1]]


def test_a_group_of_long_memories_is_bounded_by_its_tokens(spark, monkeypatch):
    monkeypatch.setattr(impacts, "GROUP_TOKENS", 100)
    memories = spark.createDataFrame([(i, "fact", "x", "alpha " * 50, 1, None) for i in range(64)], SCHEMA)
    blocks = R.build_index(memories).blocks.filter("stem = 'alpha'")
    assert blocks.count() > 10 and blocks.agg(F.sum("n")).first()[0] == 64


def test_trigram_parts_are_bounded_by_their_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "PART_CHARS", 1_000)
    rows = [(i, "fact", "x", f"long text {i} " * 20, 1, None) for i in range(30)] + [(None, "fact", "x", "long", 1, None), (99, "fact", "x", "lo", 1, None)]
    memories = spark.createDataFrame(rows, SCHEMA)
    grams = G.build_trigrams(memories)
    lists = [r.mem_ids for r in grams.filter("gram = 'lon'").collect()]
    assert len(lists) > 3 and sorted(sum(lists, [])) == list(range(30))
    assert grams.filter("n <> size(mem_ids)").count() == 0
    # A trigram does not reach from one text into the next.
    assert grams.filter("gram = ' lo'").agg(F.sum("n")).first()[0] == 30 and grams.filter("gram = 'lol'").count() == 0
