"""A trie of conversations by shared first turns, merged family by family.

A conversation c takes over the first h turns of its family's base conversation, c - c % FAMILY, and goes on with
its own turns after the first h; h is crc32(decimal c) % (MOST + 1). Turns stay where they are: what is shuffled
is a digest of each turn (role and text) and the text's bytes. Rows are dealt by base id, each family's base
first; a task streams through them, keeps the base's first MOST digests and the end of one path, and counts the
family's nodes in a small trie of its own (FLUSH nodes at most; beyond that it hands them over early, and the
merge adds them up). A node is known by the digest of its path. Only combined family nodes are shuffled again, for
the global merge.

A node that one conversation alone passes has one leaf below it and saves nothing, so sums over subtrees run on
shared nodes only, by doubling: after round r a node has what lies fewer than 2**r levels below, and knows its
ancestor 2**r levels up. Rounds are the logarithm of the shared depth, whatever the number of nodes.

The ids that end at a node are hashed in order: runs of BLOCK ids are joined first, then one pass streams them.

Defined results: rows with a null conv_id belong to no conversation; null roles and texts are empty; null turns
come first; ties of turn are ordered by role, then by the digest of role and text; rows that repeat a turn are turns of
their own; a family whose base is absent takes over nothing; conversations that are left without turns end at the root; very
long texts count whole; other columns are ignored; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.sources.scratch import Store

#: Conversations a family, and turns that a member takes over at most.
FAMILY, MOST = 5, 8
#: Nodes that a task holds of a family before it hands them over.
FLUSH = 20_000
#: Ids that are joined before they meet those of the whole node.
BLOCK = 4096

_NODES = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("bytes", pa.int64()), ("ends", pa.list_(pa.int64()))])
_NODES_SQL = "node binary, parent binary, depth long, conv_id long, n_convs long, bytes long, ends array<long>"


def turns_of(rows: DataFrame) -> DataFrame:
    """(base, other, conv_id, h, turn, role, key, bytes) of conversation rows: texts are digested where they lie."""
    c, role, text = F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = c - c % FAMILY
    # The role's length tells where it ends, so no two pairs of role and text say the same.
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    h = (F.crc32(c.cast("string").cast("binary")) % (MOST + 1)).cast("int")
    return rows.filter(c.isNotNull()).select(base.alias("base"), (c != base).alias("other"), c.alias("conv_id"), h.alias("h"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))


class _Family:
    """The trie of the family that a task is at: node -> [parent, depth, smallest member, members, bytes, ends]."""

    def __init__(self) -> None:
        self.base, self.first, self.nodes = None, [], {}

    def start(self, base: int) -> None:
        self.base, self.first, self.nodes = base, [], {}

    def begin(self, conv: int, h: int) -> None:
        self.conv, self.skip, self.at, self.depth = conv, h, b"", 0
        self.own, self.is_base = 0, conv == self.base
        self._pass(None, 0)
        for key, size in () if self.is_base else self.first[:h]:
            self._step(key, size)

    def turn(self, key: bytes, size: int) -> None:
        if self.is_base and self.own < MOST:
            self.first.append((key, size))
        # The base's own first turns are what it would take over.
        if self.own >= self.skip or self.is_base:
            self._step(key, size)
        self.own += 1

    def end(self) -> None:
        self.nodes[self.at][5].append(self.conv)

    def _step(self, key: bytes, size: int) -> None:
        parent, self.at = self.at, hashlib.blake2b(self.at + key, digest_size=20).digest()
        self.depth += 1
        self._pass(parent, size)

    def _pass(self, parent: bytes | None, size: int) -> None:
        held = self.nodes.get(self.at)
        if held is None:
            self.nodes[self.at] = [parent, self.depth, self.conv, 1, size, []]
        else:
            held[2], held[3] = min(held[2], self.conv), held[3] + 1

    def hand_over(self, but_end: bool) -> pa.RecordBatch | None:
        """The nodes so far; but_end keeps the open path's last node, which may still get its end."""
        kept = {self.at: self.nodes.pop(self.at)} if but_end else {}
        names, values = list(self.nodes), list(self.nodes.values())
        self.nodes = kept
        if not names:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((names, *([v[i] for v in values] for i in range(6))), _NODES)], schema=_NODES)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the families in a partition sorted by base, conversation and turn."""
    family, conv = _Family(), None
    for batch in batches:
        for base, c, h, key, size in zip(*(batch.column(x).to_pylist() for x in ("base", "conv_id", "h", "key", "bytes"))):
            if c != conv:
                if conv is not None:
                    family.end()
                if base != family.base:
                    if conv is not None and (out := family.hand_over(False)):
                        yield out
                    family.start(base)
                conv = c
                family.begin(c, h)
            family.turn(key, size)
            if len(family.nodes) > FLUSH and (out := family.hand_over(True)):
                yield out
    if conv is not None:
        family.end()
        if out := family.hand_over(False):
            yield out


def family_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of each family: node, parent, depth, conv_id, n_convs, bytes (of the last text), ends."""
    rows = turns_of(rows).repartition("base").sortWithinPartitions("base", "other", "conv_id", F.col("turn").asc_nulls_first(), "role", "key")
    return rows.select("base", "conv_id", "h", "key", "bytes").mapInArrow(_tries, _NODES_SQL)


def merged(families: DataFrame) -> DataFrame:
    """One row per node of all families."""
    return families.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").cast("long").alias("n_convs"), F.max("bytes").alias("bytes"))


def subtree_sums(nodes: DataFrame, values: list[str], store: Store) -> DataFrame:
    """(node, parent, values...) -> (node, values...): each summed over the node and all below it, by doubling."""
    sums = store.cut(nodes.select("node", F.col("parent").alias("up"), *values), "doubling")
    while not sums.filter("up IS NOT NULL").isEmpty():
        below = sums.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        above = sums.select(F.col("node").alias("up"), F.col("up").alias("next"))
        after = sums.join(below, "node", "left").join(above, "up", "left")
        after = store.cut(after.select("node", F.col("next").alias("up"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "doubling")
        store.drop(sums)
        sums = after
    return sums.drop("up")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's blocks of ids, of a partition sorted by node and block."""
    node, sha = None, None
    for batch in batches:
        names, digests = [], []
        for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if at != node:
                if sha:
                    names.append(node)
                    digests.append(sha.hexdigest())
                node, sha = at, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
    if sha:
        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([sha.hexdigest()], pa.string())})


def ends(families: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end."""
    ids = families.filter(F.size("ends") > 0).select("node", F.explode("ends").alias("id"))
    # A block's ids are a bounded run of numbers, so its list is bounded too.
    blocks = ids.groupBy("node", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("id")).alias("list"))
    said = F.concat_ws(",", F.transform("list", lambda x: x.cast("string")))
    return blocks.select("node", "block", said.alias("ids")).repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    store = Store(rows.sparkSession)
    families = store.cut(family_nodes(rows), "families")
    nodes = store.cut(merged(families), "nodes")
    alone: Column = F.col("n_convs") == 1
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(alone).alias("n_alone"))
    nodes = store.cut(nodes.join(children, "node", "left").fillna(0, ["n_children", "n_alone"]), "counted")
    # Below a shared node: the leaves of its lone children, those of its shared ones, or itself.
    own = nodes.filter(~alone).select("node", "parent", (F.col("n_alone") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"], store)
    shared = store.cut(nodes.filter(~alone).select("node", F.col("conv_id").alias("parent_conv_id")), "shared")
    out = nodes.join(sums, "node", "left").join(ends(families), "node", "left").join(shared.withColumnRenamed("node", "parent"), "parent", "left")
    out = out.select(
        "conv_id",
        "depth",
        # A parent that isn't shared has this node's only member.
        F.when(F.col("parent").isNotNull(), F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    out = store.cut(out, "trie")
    store.close(out)
    return out
