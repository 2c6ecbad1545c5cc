"""Prefix trie of conversations: ternary search trees by range shard, merged at the boundaries."""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm import words as W
from kinlink.llm.tables import discard, store

# Turns of one shard, on average; a shard is held by one task.
SHARD_TURNS = 50_000


def turn_digest(role, text):
    """SHA-256 of a turn; the length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def encoded_turns(rows: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """(conv, turn, digest, id, size): each turn's id in the dictionary and the bytes of its text.

    An id is a hash of the turn that the whole table shows to be one-to-one: if two different
    turns have one id, all ids are made anew with another seed.
    """
    role = F.coalesce(F.col(role_column), F.lit(""))
    text = F.coalesce(F.col(text_column), F.lit(""))
    turns = rows.select(
        F.col(id_column).cast("long").alias("conv"),
        F.col(turn_column).alias("turn"),
        turn_digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    turns = store(turns.where("conv is not null"), "turns")
    seed = 0
    while True:
        found = turns.withColumn("id", F.xxhash64(F.lit(seed), "digest"))
        both = found.groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("two"))
        if both.where("one <> two").isEmpty():
            return found
        seed += 1


def rebuilt_conversations(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv, ids, sizes): the first h turns of conversation c - c % family, then c's own after h.

    h is the CRC-32 of the decimal id modulo ``most``. A conversation is one row, by nature.
    """
    item = F.struct("turn", "digest", "id", "size")
    own = turns.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("items"))
    own = own.select(
        "conv", F.transform("items", lambda t: t["id"]).alias("ids"), F.transform("items", lambda t: t["size"]).alias("sizes")
    )
    own = store(own, "conversations")
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    base = own.select(F.col("conv").alias("base"), F.col("ids").alias("base_ids"), F.col("sizes").alias("base_sizes"))
    met = own.withColumn("h", head).withColumn("base", F.col("conv") - F.col("conv") % family).join(base, "base", "left")

    def joined(first: str, second: str):
        none = F.array().cast("array<bigint>")
        before = F.coalesce(F.slice(first, F.lit(1), F.col("h")), none)
        return F.concat(before, F.slice(second, F.col("h") + 1, F.size(second)))

    return met.select("conv", joined("base_ids", "ids").alias("ids"), joined("base_sizes", "sizes").alias("sizes"))


class TernaryTree:
    """A trie whose children hang in binary search trees: keys with links lower, equal, higher.

    Node 0 is the root. A node's trie parent is always made before it, so walking the nodes
    backwards visits every node after all of its subtree.
    """

    def __init__(self):
        self.key, self.size, self.parent, self.depth = [0], [0], [0], [0]
        self.lower, self.equal, self.higher = [-1], [-1], [-1]
        self.ends: dict[int, list[int]] = {}

    def _new(self, key: int, size: int, parent: int) -> int:
        self.key.append(key)
        self.size.append(size)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for link in (self.lower, self.equal, self.higher):
            link.append(-1)
        return len(self.key) - 1

    def insert(self, ids: list[int], sizes: list[int], members: list[int]) -> None:
        key, lower, equal, higher = self.key, self.lower, self.equal, self.higher
        node = 0
        for k, size in zip(ids, sizes):
            at, link, from_ = equal[node], equal, node
            while at >= 0 and key[at] != k:
                link, from_ = (lower, at) if k < key[at] else (higher, at)
                at = link[at]
            if at < 0:
                at = link[from_] = self._new(k, size, node)
            node = at
        self.ends[node] = members

    def path(self, ids: list[int] | None) -> list[int]:
        """The nodes that are beginnings of ``ids``, the root first; none without ``ids``."""
        if ids is None:
            return []
        found = [0]
        for k in ids:
            at = self.equal[found[-1]]
            while at >= 0 and self.key[at] != k:
                at = self.lower[at] if k < self.key[at] else self.higher[at]
            if at < 0:
                break
            found.append(at)
        return found


def medians(n: int):
    """0 to n - 1, the middle of every range before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            ranges += [(m + 1, b), (a, m)]


_NODE = (
    "part int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)


def _shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of one shard.

    ``kind`` 0 are its conversations, -1 the sequence just before it and 1 the one after. A
    node that is a beginning of one of those is shared with other shards: it has a key and
    parts of its sums, and its ``ends`` are ids instead of their hash. A shared node counts as
    a new one in the first shard that has it, and as childless in the last.
    """
    part = table["part"][0].as_py()
    kinds, convs, ids, sizes = (table[c].to_pylist() for c in ("kind", "conv", "ids", "sizes"))
    before = next((s for s, k in zip(ids, kinds) if k == -1), None)
    after = next((s for s, k in zip(ids, kinds) if k == 1), None)
    own = sorted((r for r in range(len(kinds)) if kinds[r] == 0), key=lambda r: (ids[r], convs[r]))
    heads = [i for i in range(len(own)) if i == 0 or ids[own[i]] != ids[own[i - 1]]]
    tree = TernaryTree()
    for m in medians(len(heads)):
        group = own[heads[m] : heads[m + 1] if m + 1 < len(heads) else len(own)]
        tree.insert(ids[group[0]], sizes[group[0]], [convs[r] for r in group])
    nodes = len(tree.key)
    left, right = set(tree.path(before)), set(tree.path(after))
    keys: dict[int, bytes] = {}
    for at in [*tree.path(before), *tree.path(after)]:
        above = keys.get(tree.parent[at], b"") + tree.key[at].to_bytes(8, "little", signed=True)
        keys[at] = hashlib.blake2b(above, digest_size=16).digest() if at else b""
    members, least = [0] * nodes, [None] * nodes
    children, leaves, saved = [0] * nodes, [0] * nodes, [0] * nodes
    below = [0] * nodes
    for at in range(nodes - 1, -1, -1):
        here = tree.ends.get(at)
        if here:
            members[at] += len(here)
            least[at] = here[0] if least[at] is None else min(least[at], here[0])
        if not below[at] and at not in right:
            leaves[at] = 1
        saved[at] += (members[at] - (at not in left)) * tree.size[at]
        if at:
            up = tree.parent[at]
            members[up] += members[at]
            least[up] = least[at] if least[up] is None else min(least[up], least[at])
            below[up] += 1
            children[up] += at not in left
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    ends = []
    for at in range(nodes):
        told = ",".join(map(str, tree.ends.get(at, [])))
        ends.append(told if at in keys else hashlib.sha256(told.encode()).hexdigest())
    up = [None, *tree.parent[1:]]
    columns = [
        [part] * nodes,
        [keys.get(at) for at in range(nodes)],
        [keys.get(u) for u in up],
        least,
        tree.depth,
        [None if u is None or u in keys else least[u] for u in up],
        members,
        children,
        leaves,
        saved,
        ends,
    ]
    kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    names = [field.strip().split(" ")[0] for field in _NODE.split(",")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _hashed_ends(batches):
    """(key, sha) of chunks of ids in order; one running hash, whatever a key's size."""
    key, running = None, None
    for batch in batches:
        out = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if running:
                    out.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        yield pa.record_batch([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["key", "sha"])
    if running:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["key", "sha"])


def trie_nodes(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv, ids, sizes), one row each.

    Sequences are cut into range shards by (ids, conv), so many equal ones spread over several.
    Each shard is a ternary search tree, filled median first. A node that a neighbouring shard
    has as well is a boundary node: the shards' parts of its sums are added up. Sums below a
    boundary node hold what its shards own, so no order among the nodes is needed.
    """
    convs = store(convs, "rebuilt")
    total = convs.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD_TURNS))
    placed = convs.repartitionByRange(shards, "ids", "conv").withColumn("part", F.spark_partition_id())
    placed = store(placed, "shards")
    # One row for each shard: the sequences next to it in the shards that are not empty.
    edges = placed.groupBy("part").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    line = Window.orderBy("part")
    near = edges.select("part", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    none = F.array().cast("array<bigint>")
    sides = [
        near.where(F.col(c).isNotNull()).select("part", F.lit(k).alias("kind"), F.lit(0).cast("long").alias("conv"), F.col(c).alias("ids"), none.alias("sizes"))
        for c, k in (("before", -1), ("after", 1))
    ]
    rows = placed.select("part", F.lit(0).alias("kind"), "conv", "ids", "sizes").union(sides[0]).union(sides[1])
    found = store(rows.groupBy("part").applyInArrow(_shard_nodes, _NODE), "nodes")
    shared = found.where("key is not null")
    tasks = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = shared.where("ends <> ''").repartition(tasks, "key").sortWithinPartitions("key", "part").select("key", "ends")
    hashes = chunks.mapInArrow(W.tidy(_hashed_ends), "key binary, sha string")
    merged = shared.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    merged = merged.join(hashes, "key", "left").withColumn("ends", F.coalesce("sha", empty)).drop("sha")
    merged = store(merged, "merged")
    discard(placed)
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    plain = ["conv_id", "depth", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inner = found.where("key is null").select(*plain, "parent_conv_id")
    border = merged.select(*plain, F.lit(None).cast("long").alias("parent_conv_id"))
    nodes = inner.unionByName(border).join(above, "parent_key", "left")
    return nodes.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(
    rows: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations.

    Turns are ordered by ``turn``, nulls first, equal ones by the digest of role and text; rows
    that repeat are turns of their own. Null roles and texts are empty. Rows without a
    conversation id belong to none and are left out. A conversation that is left without turns
    is a member of the root alone. Other columns are not read. An empty table has no node, not
    even a root.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), all but the hash as long.
    """
    turns = encoded_turns(rows, id_column, turn_column, role_column, text_column)
    return trie_nodes(rebuilt_conversations(turns))
