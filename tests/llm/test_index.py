"""Operators 11, 12 and 13: trie, ranked search and languages, against brute force and held-out rows."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, prefix_trie, queries, ranked_search

# Operator 11


def rebuilt_by_hand(rows):
    """conv_id -> turns, for rows (conv_id, turn, role, text) without equal turns in a conversation."""
    original = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        original[conv].append((role or "", text or ""))
    out = {}
    for conv, turns in original.items():
        first = conv - int(math.fmod(conv, 5))
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = turns if first == conv else original.get(first, [])[:h] + turns[h:]
    return out


def trie_by_hand(conversations):
    members = defaultdict(set)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(conv)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) if children[path] else 1
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[c] for c in children[path])
    return {
        (min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children[path]), leaves[path], saved[path],
         hashlib.sha256(",".join(str(c) for c in sorted(ids) if len(conversations[c]) == len(path)).encode()).hexdigest())
        for path, ids in members.items()
    }


def as_nodes(frame):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect()}


@pytest.fixture(scope="module")
def talks():
    """Shared beginnings, exact copies, odd ids, null and empty values, and conversations that lose all turns."""
    rng = np.random.default_rng(5)
    rows = []
    for conv in [*range(-12, 60), 10**12, 10**12 + 3]:
        hot = rng.random() < 0.4
        for turn in range(int(rng.integers(1, 12))):
            role = [None, "", "user", "assistant"][int(rng.integers(4))] if rng.random() < 0.3 else "user"
            text = "hot" if hot and turn < 6 else [None, "", "ä ö", "x", "ab" * 40][int(rng.integers(5))]
            rows.append((conv, None if turn == 0 else turn * 10, role, text, "extra", 1))
    rows = [r for r in rows if r[0] != 15]
    rng.shuffle(rows)
    rows = [(int(r[0]), None if r[1] is None else int(r[1]), *r[2:5], int(r[5])) for r in rows]
    return rows + [(None, 3, "user", "no conversation", "extra", 1)]


@pytest.mark.parametrize("convs, turns", [(2048, 65_536), (3, 65_536), (64, 5)])
def test_trie(spark, talks, convs, turns):
    frame = spark.createDataFrame(talks, "conv_id long, turn int, role string, text string, digest string, position int")
    want = trie_by_hand(rebuilt_by_hand([r[:4] for r in talks]))
    got = prefix_trie.rebuilt_trie(frame.repartition(5), max_convs=convs, max_turns=turns)
    assert got.count() == len(want)
    assert as_nodes(got) == want


def test_trie_of_conversations_as_they_are(spark):
    """Long common paths over many shards: the sums need several doublings."""
    path = [("user", f"turn {i}") for i in range(21)]
    talks = {c: path[: 5 + c % 17] + ([("user", f"own {c}")] if c % 3 else []) for c in range(200)}
    rows = [(c, i, *turn) for c, turns in talks.items() for i, turn in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = prefix_trie.prefix_trie(prefix_trie.with_starts(prefix_trie.numbered_turns(frame)), max_convs=9)
    assert as_nodes(got) == trie_by_hand(talks)


def test_trie_odd_tables(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], schema)).collect() == []
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).collect() == []
    # A repeated row is a turn of its own, and the order of equal turns does not depend on the order of rows.
    rows = [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "b"), (10, 1, "user", "b" * 300_000)]
    first, second = (as_nodes(prefix_trie.rebuilt_trie(spark.createDataFrame(r, schema))) for r in (rows, rows[::-1]))
    assert first == second
    assert {n[:2] for n in first} == {(5, 0), (5, 1), (5, 2), (5, 3), (10, 1)}
    assert {n[6] for n in first if n[1] == 0} == {0}


# Operator 12


def terms_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def ranked_by_hand(docs, items, k=20):
    """{place of item: [(rank, doc_id, score)]} for docs and items (id, text)."""
    bags = [Counter(terms_of(text)) for _, text in docs]
    n_docs, n_terms = sum(bool(b) for b in bags), sum(b.total() for b in bags)
    df = Counter(t for b in bags for t in b)
    out = {}
    for place, (_, text) in enumerate(items):
        scored = []
        for (doc, _), bag in zip(docs, bags):
            if bag:
                m = 100 - 25 + (25 * bag.total() * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms_of(text) if bag[t])
                if score > 0:
                    scored.append((-score, doc is not None, doc if doc is not None else 0, doc))
        out[place] = [(rank, entry[3], -entry[0]) for rank, entry in enumerate(sorted(scored, key=lambda e: e[:3])[:k], 1)]
    return out


def as_ranks(frame):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


@pytest.fixture(scope="module")
def shelf():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "ÄB", "日本", "A1", "the"]
    odds = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 40)), p=odds / odds.sum())) for _ in range(300)]
    texts += texts[:20] + [None, "", " .,;", "the " * 5000, "the-THE_the\x00the", "w1" * 3] + ["copy of one text w3 w9"] * 30
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)] + [(None, "w1 w5 naïve"), (7, "w1 w5 naïve")]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(15)] + [(1, "w3 w9 w9"), (None, "copy w3"), (50, ""), (51, None), (52, "unknown"), (53, "the"), (53, "the")]
    return docs, items


@pytest.mark.parametrize("block, size", [(8 << 20, 8 << 20), (700, 100)])
def test_ranked_search(spark, shelf, block, size):
    docs, items = shelf
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, item_id int").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string").repartition(2)
    got = ranked_search.search(ranked_search.build_index(frame, block_bytes=block), asked, query_bytes=size)
    want = Counter((items[place][0], *row) for place, rows in ranked_by_hand(docs, items).items() for row in rows)
    assert as_ranks(got) == want


def test_limited_accumulators_skip_documents(monkeypatch, spark):
    """Frequent terms behind rare ones make no accumulators: survivors are few, results are whole."""
    seen = []
    plain = ranked_search._Block._survivors
    monkeypatch.setattr(ranked_search._Block, "_survivors", lambda self, sums, *rest: seen.append(int((sums > 0).sum())) or plain(self, sums, *rest))
    texts = [f"{'rare1 rare2 ' if i < 25 else ''}common {'often' if i % 2 else ''}" for i in range(3000)]
    block = pa.record_batch({"doc_id": pa.array(range(3000), pa.int64()), "text": pa.array(texts)})
    names = ["n_docs", "n_terms", "ids", "lengths", "terms", "frequencies", "docs", "times"]
    row = dict(zip(names, ranked_search._block_row(block)))
    wanted = pa.array([b"rare1", b"rare2", b"often", b"common"], pa.binary())
    n_docs, n_terms = row["n_docs"], row["n_terms"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in (25, 25, 1500, 3000)], np.int64)
    found = ranked_search._Block(row, wanted, weights, n_docs, n_terms).best({0: 1, 1: 1, 2: 1, 3: 1}, weights, 20, 0)
    assert seen and max(seen) == 25
    best = sorted(((-s, d) for s, d in found))[:20]
    assert [(rank, d, -s) for rank, (s, d) in enumerate(best, 1)] == ranked_by_hand(list(enumerate(texts)), [(0, "rare1 rare2 often common")])[0]


def test_ranked_search_odd_tables(spark, shelf):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "two three")], "item_id string, text string")
    assert [(r.item_id, r["rank"], r.doc_id) for r in ranked_search.search(ranked_search.build_index(docs), items).orderBy("rank").collect()] == [("q", 1, None), ("q", 2, "a"), ("q", 3, "b")]
    assert ranked_search.search(ranked_search.build_index(docs.limit(0)), items).collect() == []
    assert ranked_search.search(ranked_search.build_index(docs), items.limit(0)).collect() == []
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ranked_search.search(ranked_search.build_index(empty), items).collect() == []


# Operator 13


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == docs.count()
    langs = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    asked = [r for r in rows if r.held_out and langs[r.doc_id] is not None]
    assert sum(r.lang_pred == langs[r.doc_id] for r in asked) >= 0.99 * len(asked)


def test_languages_do_not_use_labels_or_other_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    as_rows = lambda frame: sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in frame.collect())
    hidden = docs.withColumn("lang", F.when(~language_id.held_out(), F.col("lang"))).withColumn("source", F.lit(None)).withColumn("score", F.lit("clash"))
    assert as_rows(language_id.predict_languages(docs)) == as_rows(language_id.predict_languages(hidden.repartition(3)))


def test_families_by_likeness():
    rng = np.random.default_rng(2)
    bases = [rng.random(language_id.DIMS) ** 8 for _ in range(3)]
    counts = {f"l{i}": (1000 * (bases[i % 3] + 0.1 * rng.random(language_id.DIMS) ** 8)).astype(int) for i in range(9)}
    family = language_id.families(counts)
    assert all((family[f"l{i}"] == family[f"l{j}"]) == (i % 3 == j % 3) for i in range(9) for j in range(9))
    assert language_id.families({}) == {}


def test_pair_machine_separates():
    rng = np.random.default_rng(4)
    signs = np.array([1.0] * 30 + [-1.0] * 200)
    x = rng.normal(0, 0.1, (230, 20)).astype(np.float32)
    x[:, 0] += signs
    w, bias, scale = language_id.fit_pair(x, signs)
    assert (np.sign(x @ w + bias) == signs).all() and scale > 0


def test_profiles_of_a_text_do_not_depend_on_its_neighbours():
    texts = pa.array(["ab", None, "", "Ab é!", "é", "1 2", "日本 x"])
    together = language_id.profiles(texts)
    alone = np.vstack([language_id.profiles(texts.slice(i, 1)) for i in range(len(texts))])
    assert (together == alone).all()
    assert together.sum(axis=1).tolist() == [4, 0, 0, 8, 4, 0, 14]
    assert language_id.has_letter(pa.array(["1", None, "", "é", "a", "…—", "½", "日"])).tolist() == [False, False, False, True, True, False, False, True]


def peak_mb(run):
    """MB of arrays held at most while run() lasts, beside those held before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_languages_hold_little_at_once():
    langs = ("de", "en", "fr")
    counts = {lang: language_id.profiles(pa.array([f"text in {lang}"]))[0] for lang in langs}
    machine = (np.ones(language_id.DIMS), 0.0, 1.0)
    model = language_id.Model(counts, dict.fromkeys(langs, 0), {(a, b): machine for a in langs for b in langs if a < b})
    short = pa.RecordBatch.from_pydict({"text": [f"one short text, number {i}" for i in range(4000)]})
    assert peak_mb(lambda: [model.predict(block.column("text")) for block in language_id._blocks([short])]) < 64
    assert peak_mb(lambda: model.predict(pa.array(["a long text of one row, " * 200_000]))) < 64
    x = np.zeros((1000, language_id.DIMS), np.float32)
    x[::2, 0] = x[1::2, 1] = 1
    assert peak_mb(lambda: language_id.fit_pair(x, x[:, 0].astype(float) * 2 - 1)) < 32


def test_profiles_of_texts_longer_than_a_step():
    word = "Añb "
    times = language_id._STEP // len(word.encode()) + 1000
    texts = pa.array(["x", word * times, "", "y" * (2 * language_id._STEP + 1)])
    one, long, empty, run = language_id.profiles(texts)
    assert (long == language_id.profiles(pa.array([word]))[0] * times).all()
    assert one.sum() == 2 and not empty.any()
    # A run of one letter: its beginning, its end, and all the same between.
    n = 2 * language_id._STEP + 1
    assert sorted(run[run > 0].tolist()) == [1, 1, n - 2, n]


def test_languages_odd_tables(spark):
    schema = "doc_id string, text string, lang string"
    rows = [("a", None, "en"), ("b", "123 …", "en"), (None, "hello world", "en"), ("c", "hello there", "en"), ("c", "hello there", "en"), ("d", "x" * 2_000_000, None)]
    got = language_id.predict_languages(spark.createDataFrame(rows, schema))
    assert sorted((r.doc_id or "", r.lang_pred) for r in got.collect()) == [("", "en"), ("a", "und"), ("b", "und"), ("c", "en"), ("c", "en"), ("d", "en")]
    unlabelled = spark.createDataFrame([("a", "text", None)], schema)
    assert [(r.lang_pred, r.score) for r in language_id.predict_languages(unlabelled).collect()] == [("und", 0.0)]
    assert language_id.predict_languages(unlabelled.limit(0)).collect() == []
