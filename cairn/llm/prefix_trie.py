"""Prefix trie of conversations, merged family first.

A family is all conversations with one base id. Turns are reduced to a digest and a length in the JVM and dealt by family,
the base conversation first (a cogroup by secondary sort, so a family is a stream). A task rebuilds each conversation from
the base's first turns and its own, names each prefix by a chained digest, and folds the family into its small trie, of
which only combined nodes leave the task: in how many conversations, the smallest of them, and the ids that end there.
Nodes of all families are then summed by name, with partial sums before the shuffle. Ids that end at a node are hashed by
one stream over the families in order; a family's ids are one string.

Sums over subtrees are needed at shared nodes alone (a node of one conversation has one leaf below and saves nothing).
They are found by doubling: each round adds to a node what lies twice as far below, so rounds follow the logarithm of the
depth, whatever its value.

Cases: turns stand in order of turn (null first), then of the digest of role and text; a null role or text is empty; turns
without conv_id belong to no conversation; a base without turns lends none; a conversation may be rebuilt to no turns and
is then a member of the root alone; an empty table has no node; texts of any length are hashed whole; other columns are
ignored. A family's stream holds `flush_nodes` nodes at most: beyond, what there is of it leaves the task in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC32_SQL, release, staged

#: Ids of a family share the number of hundreds; so many turns at most come from its first conversation.
FAMILY, MOST_LENT = 100, 5
ROOT = bytes(16)
NODES = "node binary, up binary, depth long, last long, n long, conv long, first long, ends string"


def lent(conv: int) -> int:
    return crc32(str(conv).encode()) % (MOST_LENT + 1)


class Family:
    """The trie of the family that a task is reading. fold() moves its nodes to the rows that are ready, rows() takes them."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.head: list[tuple[bytes, int]] = []
        self.nodes: dict[bytes, list] = {}
        self.ready: list[tuple] = []
        self.conv: int | None = None

    def start(self, base: int) -> None:
        self.fold()
        self.base, self.head = base, []

    def open(self, conv: int) -> None:
        self.conv, self.seen, self.name, self.depth, self.skip = conv, 0, ROOT, 0, lent(conv)
        self.visit(ROOT, None, 0)
        if conv != self.base:
            for digest, size in self.head[: self.skip]:
                self.step(digest, size)

    def visit(self, name: bytes, up: bytes | None, size: int) -> None:
        node = self.nodes.get(name)
        if node is None:
            self.nodes[name] = [up, self.depth, size, 1, self.conv, []]
        else:
            node[3] += 1
            node[4] = min(node[4], self.conv)

    def step(self, digest: bytes, size: int) -> None:
        up, self.depth = self.name, self.depth + 1
        self.name = sha256(up + digest).digest()[:16]
        self.visit(self.name, up, size)

    def turn(self, digest: bytes, size: int) -> None:
        self.seen += 1
        if self.conv == self.base:
            if len(self.head) < MOST_LENT:
                self.head.append((digest, size))
            self.step(digest, size)
        elif self.seen > self.skip:
            self.step(digest, size)

    def close(self) -> None:
        if self.conv is not None:
            # Parts that left the task may have held the last node.
            node = self.nodes.setdefault(self.name, [None, self.depth, 0, 0, self.conv, []])
            node[5].append(self.conv)
            self.conv = None

    def fold(self) -> None:
        for name, (*node, ends) in self.nodes.items():
            # The base comes first in the stream; among negative ids that isn't its place in the order.
            low = [c for c in ends if c < self.base]
            runs = [r for r in (low, [c for c in ends if c == self.base], [c for c in ends if c > self.base]) if r] if low else [ends]
            self.ready.append((name, *node, runs[0][0] if ends else None, ",".join(map(str, runs[0])) or None))
            self.ready += [(name, *node[:3], 0, node[4], r[0], ",".join(map(str, r))) for r in runs[1:]]
        self.nodes = {}

    def rows(self) -> pa.RecordBatch:
        cols = list(zip(*self.ready)) if self.ready else [[] for _ in range(8)]
        self.ready = []
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["node", "up", "depth", "last", "n", "conv", "first", "ends"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _families(flush_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for batch in batches:
            for base, conv, digest, size in zip(*[batch.column(c).to_pylist() for c in ("base", "conv", "turn_sha", "size")]):
                if conv != family.conv:
                    family.close()
                    if base != family.base:
                        family.start(base)
                    family.open(conv)
                family.turn(digest, size)
                if len(family.nodes) >= flush_nodes:
                    family.fold()
                if len(family.ready) >= 4096:
                    yield family.rows()
        family.close()
        family.fold()
        yield family.rows()

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each node, whose strings come in order."""
    name, state = None, None
    for batch in batches:
        out = []
        for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if node == name:
                state.update(b"," + ends.encode())
            else:
                if name is not None:
                    out.append((name, state.hexdigest()))
                name, state = node, sha256(ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["node", "ends_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def family_nodes(turns: DataFrame, flush_nodes: int = 200_000) -> DataFrame:
    """Combined nodes of each family of turns(conv_id, turn, role, text)."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in ("role", "text"))
    sha = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    conv = turns["conv_id"].cast("long")
    narrow = turns.filter(turns["conv_id"].isNotNull()).select((conv - conv % FAMILY).alias("base"), conv.alias("conv"), turns["turn"].alias("turn"), sha.alias("turn_sha"), F.length(text).cast("long").alias("size"))
    dealt = narrow.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", "turn", "turn_sha")
    return dealt.mapInArrow(_families(flush_nodes), NODES)


def _below(shared: DataFrame, sums: list[str]) -> DataFrame:
    """shared(node, up, depth, *sums) with the sums over the subtree of each node (of those nodes), by doubling."""
    table = staged(shared.select("node", F.col("up").alias("far"), "depth", *sums), "trie-below")
    deepest = table.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        below = table.filter("far is not null").groupBy(F.col("far").alias("_far")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        onward = table.filter("far is not null").select(F.col("node").alias("_node"), F.col("far").alias("_next"))
        step = table.join(below, F.col("node") == F.col("_far"), "left").join(onward, F.col("far") == F.col("_node"), "left")
        step = staged(step.select("node", F.col("_next").alias("far"), "depth", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]), "trie-below")
        release(table)
        table, reach = step, reach * 2
    return table.drop("far", "depth")


def prefix_trie(turns: DataFrame, flush_nodes: int = 200_000) -> DataFrame:
    """node (digest that names it), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 of each prefix of the rebuilt conversations."""
    parts = staged(family_nodes(turns, flush_nodes), "trie-families")
    merged = parts.groupBy("node").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min("conv").alias("conv"))
    merged = staged(merged, "trie-nodes")
    ended = parts.filter("ends is not null").select("node", "first", "ends").repartition("node").sortWithinPartitions("node", "first").mapInArrow(_ends, "node binary, ends_sha256 string")
    # Children that only one conversation passes have one leaf each and no sum of their own.
    children = merged.filter("up is not null").groupBy(F.col("up").alias("_up")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("single"))
    shared = merged.filter("n > 1").join(children, F.col("node") == F.col("_up"), "left")
    own = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("single")).cast("long")
    sums = _below(shared.select("node", "up", "depth", own.alias("leaves"), ((F.col("n") - 1) * F.col("last")).alias("saved")), ["leaves", "saved"])
    parent = merged.select(F.col("node").alias("_above"), F.col("conv").alias("parent_conv_id"))
    out = merged.join(children, F.col("node") == F.col("_up"), "left").join(parent, F.col("up") == F.col("_above"), "left")
    out = out.join(ended.withColumnRenamed("node", "_ended"), F.col("node") == F.col("_ended"), "left").join(sums.withColumnRenamed("node", "_sum"), F.col("node") == F.col("_sum"), "left")
    return out.select(
        F.hex("node").alias("node"),
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS base, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
    length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT c, base, (SELECT {CRC32_SQL} FROM (SELECT c::VARCHAR AS s)) % 6 AS h FROM (SELECT DISTINCT c, base FROM own)),
rebuilt AS (
  SELECT v.c, o.r AS k, o.d, o.size FROM convs v JOIN own o ON o.c = v.base AND o.r <= v.h
  UNION ALL
  SELECT v.c, 5 + o.r, o.d, o.size FROM convs v JOIN own o ON o.c = v.c AND o.r > v.h
),
pathed AS (
  SELECT c, row_number() OVER w AS depth, size, sha256(string_agg(d, '' ) OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING)) AS node FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY k)
  UNION ALL
  SELECT c, 0, 0, '' FROM convs
),
ends AS (SELECT c, arg_max(node, depth) AS node FROM pathed GROUP BY c),
nodes AS (SELECT node, any_value(depth) AS depth, any_value(size) AS size, count(*) AS n, min(c) AS c FROM pathed GROUP BY node),
parents AS (SELECT n.node, p.node AS up FROM nodes n JOIN pathed p ON p.c = n.c AND p.depth = n.depth - 1),
children AS (SELECT up, count(*) AS n_children FROM parents GROUP BY up),
below AS (
  SELECT a.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n - 1) * n.size) AS saved
  FROM nodes n LEFT JOIN children k ON k.up = n.node JOIN pathed a ON a.c = n.c AND a.depth <= n.depth GROUP BY a.node
),
listed AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM ends GROUP BY node)
SELECT n.c AS conv_id, n.depth::BIGINT AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children,
  b.n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN parents u ON u.node = n.node LEFT JOIN nodes p ON p.node = u.up LEFT JOIN children k ON k.up = n.node
JOIN below b ON b.node = n.node LEFT JOIN listed l ON l.node = n.node
"""
