"""Operator 11: the prefix trie of conversations, by vertical bitmaps.

Turns become 128-bit digests where they are read; no later step moves a text. Conversations are
range-partitioned by id and cut into shards of at most `SHARD_CONVS` conversations (and about
`SHARD_TURNS` turns). A shard's index maps (position, turn) to the bitset of its conversations with
that turn there. The trie is walked depth first: the lowest conversation of a node's bitset names
the next turn, and the bitset's intersection with that turn's posting is the child; popcounts are
members, and the intersection with the bitset of conversations of that length is the end list.

Nodes of all shards meet by the digest of their path. A node in one shard only has its whole subtree
there, so the shard's own sums hold. Nodes of several shards are the top of the trie: their sums add
up along ancestors at distance 1, 2, 4, ..., which every shard knows for its own paths, so the
number of rounds is the logarithm of the depth and no round joins on a shared ancestor. A shard is one
row of a node's end list, so a node at which a third of all conversations end is a stream of a few
rows that are hashed in order of id.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

SHARD_CONVS = 2048
SHARD_TURNS = 65_536
#: Conversations of a family of five ids share the beginning of the first of them.
FAMILY = 5
MAX_SHARED = 8

_NO_ENDS = hashlib.sha256(b"").hexdigest()
_ROOT = bytes(16)
_SHARD_SCHEMA = pa.schema([
    ("key", pa.binary()), ("parent", pa.binary()), ("jumps", pa.list_(pa.binary())), ("shard", pa.int64()),
    ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_bytes", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("first_end", pa.int64()), ("ends", pa.string()), ("ends_sha256", pa.string()),
])
_SHARD_DDL = (
    "key binary, parent binary, jumps array<binary>, shard long, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_bytes long, n_children long, n_leaves long, saved_tokens long, first_end long, ends string, ends_sha256 string"
)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, digest, n_bytes): each conversation's turns by turn, null first, from 1.

    A null role or text counts as empty. Equal turns of one conversation are ordered by digest;
    repeated rows are turns of their own. Rows without conv_id are left out. Other columns are not read.
    A conversation is one sorted run of narrow rows that a task streams.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    ).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest", "n_bytes")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("position"), "digest", "n_bytes")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """Numbered turns in which conversation c begins as the conversation c - c % 5 does.

    The first h = crc32(c as text) % 9 turns are those of c - c % 5 (fewer or none if it has not as
    many), then come c's own turns after its first h. Position 0 is a row without turn that each
    conversation has, so that one without any turn left is still there.
    """
    turns = stage(turns, "trie-turns")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    shared = F.crc32(F.col("conv_id").cast("string")) % (MAX_SHARED + 1)
    conversations = turns.where("position = 1").select("conv_id")
    own = turns.where((F.col("conv_id") == first) | (F.col("position") > shared))
    heirs = conversations.where(F.col("conv_id") != first).select(F.col("conv_id").alias("heir"), first.alias("conv_id"), shared.alias("h"))
    lent = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("position") <= MAX_SHARED)).join(heirs, "conv_id").where("position <= h")
    return own.union(lent.select(F.col("heir").alias("conv_id"), "position", "digest", "n_bytes")).union(_starts(conversations))


def _starts(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"))


def with_starts(turns: DataFrame) -> DataFrame:
    """Numbered turns as they are, with the row at position 0 that `prefix_trie` expects."""
    turns = stage(turns, "trie-turns")
    return turns.union(_starts(turns.where("position = 1").select("conv_id")))


class _Shard:
    """The vertical index of one shard and its trie."""

    def __init__(self, ids: list[int], turns: list[list[bytes]], sizes: list[list[int]]):
        self.ids, self.turns, self.sizes = ids, turns, sizes
        self.postings: dict[tuple[int, bytes], int] = defaultdict(int)
        self.ended: dict[int, int] = defaultdict(int)
        for i, path in enumerate(turns):
            self.ended[len(path)] |= 1 << i
            for position, digest in enumerate(path):
                self.postings[position, digest] |= 1 << i

    def nodes(self) -> pa.RecordBatch:
        keys, parents, depths, members, sizes, ups = [], [], [], [], [], []
        children: list[int] = []
        walk = [((1 << len(self.ids)) - 1, 0, _ROOT, -1, 0)]
        while walk:
            bits, depth, key, parent, size = walk.pop()
            node = len(keys)
            keys.append(key)
            parents.append(parent)
            depths.append(depth)
            members.append(bits)
            sizes.append(size)
            children.append(0)
            up = [parent] if parent >= 0 else []
            while up and len(ups[up[-1]]) >= len(up):
                up.append(ups[up[-1]][len(up) - 1])
            ups.append(up)
            rest = bits & ~self.ended.get(depth, 0)
            while rest:
                lowest = (rest & -rest).bit_length() - 1
                digest = self.turns[lowest][depth]
                child = rest & self.postings[depth, digest]
                rest ^= child
                children[node] += 1
                walk.append((child, depth + 1, hashlib.sha256(key + digest).digest()[:16], node, self.sizes[lowest][depth]))
        counts = [bits.bit_count() for bits in members]
        leaves = [int(n == 0) for n in children]
        saved = [(n - 1) * size for n, size in zip(counts, sizes)]
        for node in range(len(keys) - 1, 0, -1):
            leaves[parents[node]] += leaves[node]
            saved[parents[node]] += saved[node]
        smallest = [self.ids[(bits & -bits).bit_length() - 1] for bits in members]
        firsts, ends, hashes = [], [], []
        for bits, depth in zip(members, depths):
            here = self._ids_of(bits & self.ended.get(depth, 0))
            text = ",".join(map(str, here)) if here else None
            firsts.append(here[0] if here else None)
            ends.append(text)
            hashes.append(hashlib.sha256(text.encode()).hexdigest() if here else None)
        return pa.RecordBatch.from_arrays([
            pa.array(keys, pa.binary()), pa.array([keys[p] if p >= 0 else None for p in parents], pa.binary()),
            pa.array([[keys[a] for a in up] for up in ups], pa.list_(pa.binary())), pa.array([self.ids[0]] * len(keys), pa.int64()),
            pa.array(depths, pa.int64()), pa.array(smallest, pa.int64()),
            pa.array([smallest[p] if p >= 0 else None for p in parents], pa.int64()), pa.array(counts, pa.int64()),
            pa.array(sizes, pa.int64()), pa.array(children, pa.int64()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()),
            pa.array(firsts, pa.int64()), pa.array(ends, pa.string()), pa.array(hashes, pa.string()),
        ], schema=_SHARD_SCHEMA)

    def _ids_of(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out


def _shards(batches: Iterator[pa.RecordBatch], max_convs: int, max_turns: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, position, digest, n_bytes) in, each shard's nodes out."""
    ids: list[int] = []
    turns: list[list[bytes]] = []
    sizes: list[list[int]] = []
    held = 0
    for batch in batches:
        for conv, position, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "digest", "n_bytes"))):
            if position == 0:
                if len(ids) >= max_convs or held >= max_turns:
                    yield _Shard(ids, turns, sizes).nodes()
                    ids, turns, sizes, held = [], [], [], 0
                ids.append(conv)
                turns.append([])
                sizes.append([])
            else:
                turns[-1].append(digest)
                sizes[-1].append(size)
                held += 1
    if ids:
        yield _Shard(ids, turns, sizes).nodes()


def _ends_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, ends) in; one hash per key over its end lists, joined by commas."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if done:
            yield _hash_rows(done)
    if state is not None:
        yield _hash_rows([(key, state.hexdigest())])


def _hash_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], names=["key", "joined"])


def prefix_trie(turns: DataFrame, max_convs: int = SHARD_CONVS, max_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per trie node over numbered turns that have a row at position 0 for each conversation.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (over the subtree, members but one times bytes of
    the node's last text), ends_sha256 (of the ascending ids, joined by commas, of members that end here).
    An empty table has no node.
    """
    turns = stage(turns, "trie-rebuilt")
    local = stage(
        turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "position")
        .mapInArrow(lambda batches: _shards(batches, max_convs, max_turns), _SHARD_DDL), "trie-shards")
    nodes = stage(local.groupBy("key").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("n_bytes").alias("n_bytes"),
        F.min("conv_id").alias("conv_id"), F.min("shard").alias("shard"), F.count(F.lit(1)).alias("n_shards"),
        F.sum("n_convs").alias("n_convs"), F.max("n_children").alias("n_children"), F.max("n_leaves").alias("n_leaves"),
        F.max("saved_tokens").alias("saved_tokens"), F.min("parent_conv_id").alias("parent_conv_id"),
        F.count("first_end").alias("end_shards"), F.max("ends_sha256").alias("ends_sha256"),
    ), "trie-nodes")
    shared, private = nodes.where("n_shards > 1"), nodes.where("n_shards = 1")
    top = _shared_sums(shared, nodes, local)

    # A node's parent lies in each of the node's shards: the pair (parent, shard) is met by few nodes.
    copies = local.select("key", "shard").join(shared.select("key", F.col("conv_id").alias("least")), "key")
    copies = copies.select(F.col("key").alias("parent"), "shard", "least")
    joined = private.select("key", "parent", "shard", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_shards", "ends_sha256")
    joined = joined.unionByName(top).join(copies, ["parent", "shard"], "left")
    many = nodes.where("end_shards > 1").select("key")
    lists = local.where("first_end is not null").select("key", "first_end", "ends").join(many, "key", "left_semi")
    hashes = lists.repartition("key").sortWithinPartitions("key", "first_end").select("key", "ends").mapInArrow(_ends_hashes, "key binary, joined string")
    return joined.join(hashes, "key", "left").select(
        "conv_id", "depth", F.coalesce("least", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("joined", "ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def _shared_sums(shared: DataFrame, nodes: DataFrame, local: DataFrame) -> DataFrame:
    """Nodes of several shards with their counts over the whole trie."""
    own = F.col("n_shards") == 1
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("children"), F.sum(F.when(own, F.col("n_leaves"))).alias("leaves"), F.sum(F.when(own, F.col("saved_tokens"))).alias("saved"))
    paths = local.select("key", "shard", "jumps")
    sums = stage(
        shared.join(below, "key", "left").join(paths, ["key", "shard"]).select(
            "key", "parent", "shard", "depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"),
            (F.coalesce("leaves", F.lit(0)) + F.when(F.col("children").isNull(), 1).otherwise(0)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
            "end_shards", "ends_sha256", "jumps",
        ), "trie-shared")
    deepest = sums.agg(F.max("depth")).first()[0] or 0
    for k in range(deepest.bit_length()):
        # After round k a node's sums cover the 2 ** (k + 1) levels from itself down.
        passed = sums.where(F.size("jumps") > k).groupBy(F.col("jumps")[k].alias("key")).agg(
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        sums = stage(sums.join(passed, "key", "left").select(
            *[c for c in sums.columns if c not in ("n_leaves", "saved_tokens")],
            (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        ), "trie-sums")
    return sums.drop("jumps")


def rebuilt_trie(conversations: DataFrame, **bounds: int) -> DataFrame:
    """`prefix_trie` of conversations rebuilt by `rebuilt_turns`."""
    return prefix_trie(rebuilt_turns(numbered_turns(conversations)), **bounds)


ORACLE = """
WITH crc AS (
  SELECT c, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: list_reduce(list_concat([xor(s, b)], list_transform(range(8), lambda i: 0::BIGINT)),
      lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) AS state
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (SELECT c, c - c % 5 AS p, xor(state, 4294967295) % 9 AS h FROM crc),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT v.c, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.p AND t.pos <= v.h
  UNION ALL
  SELECT v.c, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h
), dense AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, role, text FROM rebuilt
), steps AS (
  SELECT c, d, strlen(text) AS bytes, string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS path
  FROM dense
), members AS (
  SELECT c, 0 AS d, 0 AS bytes, '' AS path FROM convs UNION ALL SELECT c, d, bytes, path FROM steps
), lengths AS (SELECT c, max(d) AS len FROM members GROUP BY c),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN len = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM members JOIN lengths USING (c) GROUP BY path, d
), parents AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(p.n, 0) AS n_children FROM nodes n LEFT JOIN parents p USING (path)),
above AS (SELECT f.path, f.d, f.n_convs, f.bytes, f.n_children, unnest(range(f.d + 1)) AS up FROM full_nodes f),
sums AS (
  SELECT left(path, 64 * up) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM above GROUP BY 1
)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s USING (path) LEFT JOIN nodes p ON f.d > 0 AND p.path = left(f.path, 64 * (f.d - 1))
"""
