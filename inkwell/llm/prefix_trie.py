"""The trie of all conversation prefixes, by chained cryptographic digests.

A turn's digest is the SHA-256 of its role and text. A conversation is cut into
blocks of ``BLOCK`` turns. A prefix's digest is chained turn by turn from the
block's start, and a full block's last one is the SHA-256 of the block's start
and all its turns' digests, which starts the next block. So equal digests are
equal prefixes, blocks are chained apart from each other, and only one digest
for each full block is chained along a whole conversation.

Every prefix is exploded and grouped by (depth, digest): these are the nodes.
For sums over subtrees each node is exploded to all its ancestors within its
block. A node at a block's end (a joint) stands for all that lies below it: the
sums below joints come from the same step over the trie of joints, whose depths
are smaller by the factor ``BLOCK``. Conversations of at most ``BLOCK`` turns,
nearly all of them, take one step; a conversation of n turns makes n * BLOCK / 2 rows
and not n * n / 2.

Turns are numbered within their conversation by a range sort (a conversation
may lie in many tasks) and the counts of the tasks before. The digests of
a node's ending conversations are hashed as a stream in their order; no list of
them is ever held.

Defined results: rows without conv_id take no part; null roles and texts are
empty; turns of equal number are ordered by role, then by the digest of role
and text; repeated rows are turns each; other columns are ignored; an empty
table gives no rows (no conversation, no root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import NUMBER_ROWS, TEXT_ROWS, batch_rows, discard, lean, materialize

#: Turns of a block.
BLOCK = 32
ROOT = hashlib.sha256(b"root").digest()
_NONE = hashlib.sha256(b"").hexdigest()


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n (its place in the conversation, from 1), td (digest of role and text), chars; materialized."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    td = _sha(F.concat_ws(":", F.length(role).cast("string"), role, text))
    src = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), td.alias("td"), F.length(text).cast("long").alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "td"]
    dealt = src.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("conv_id", "td", "chars", F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftright("at", 33).alias("part")
    runs = dealt.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    out = materialize(dealt.withColumn("part", part).join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("n"), "td", "chars"), "numbered")
    discard(dealt)
    return out


def shared_heads(numbered: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with another one's first turns.

    Conversation c gets the first h turns of conversation c - c % every, then its
    own turns after its first h; h is the CRC-32 of c in decimals, modulo ``most``.
    Returns conv_id, d (place, from 1), td, chars; and conv_id, len of every conversation.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % F.lit(most)
    base = F.col("conv_id") - F.col("conv_id") % F.lit(every)
    heads = numbered.filter(F.col("n") < most).filter(F.col("conv_id") % F.lit(every) == 0).select(F.col("conv_id").alias("base"), "n", "td", "chars")
    held = heads.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    convs = numbered.groupBy("conv_id").agg(F.max("n").alias("own")).withColumns({"h": h, "base": base}).join(held, "base", "left")
    taken = F.least("h", F.coalesce("held", F.lit(0)))
    convs = materialize(convs.withColumn("taken", taken), "conversations")
    first = convs.filter("h > 0").join(heads, "base").filter("n <= h").select("conv_id", F.col("n").alias("d"), "td", "chars")
    # a conversation's own turns move only where its base has fewer than h turns
    moved = convs.filter("taken < h and own > h").select("conv_id", (F.col("h") - F.col("taken")).alias("gap"))
    rest = numbered.filter(F.col("n") > h).join(moved, "conv_id", "left").select("conv_id", (F.col("n") - F.coalesce("gap", F.lit(0))).alias("d"), "td", "chars")
    return first.unionByName(rest), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))


@lean
def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads conv_id, blk and the full block's digest, sorted; hands on the digest that each next block starts with."""
    conv, start = None, ROOT
    for batch in batches:
        convs, blks, digests = (batch.column(i).to_pylist() for i in range(3))
        out = []
        for c, x in zip(convs, digests, strict=True):
            if c != conv:
                conv, start = c, ROOT
            start = hashlib.sha256(start + x).digest()
            out.append(start)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b + 1 for b in blks], pa.int64()), pa.array(out, pa.binary())], ["conv_id", "blk", "start"])


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """conv_id, blk, acc (digests of the prefixes: of the block's start, then of each turn), chars."""
    blk = F.floor((F.col("d") - 1) / size).alias("blk")
    held = rows.groupBy("conv_id", blk).agg(F.sort_array(F.collect_list(F.struct("d", "td", "chars"))).alias("t"))
    whole = _sha(F.array_join(F.transform("t", lambda x: F.hex(x["td"])), ""))
    held = materialize(held.withColumn("whole", F.when(F.size("t") == size, whole)), "blocks")
    full = held.filter("whole is not null").select("conv_id", "blk", "whole").repartition("conv_id").sortWithinPartitions("conv_id", "blk")
    starts = materialize(full.mapInArrow(_chained, "conv_id bigint, blk bigint, start binary"), "starts")
    # a start is needed by the block that it opens; a full block ends on the start of the next one
    with_start = held.join(starts, ["conv_id", "blk"], "left").withColumn("start", F.coalesce("start", F.lit(bytearray(ROOT))))
    steps = F.aggregate("t", F.array("start"), lambda acc, x: F.concat(acc, F.array(_sha(F.concat(F.element_at(acc, -1), x["td"])))))
    last = _sha(F.concat("start", "whole"))
    acc = F.when(F.col("whole").isNull(), steps).otherwise(F.concat(F.slice(steps, 1, size), F.array(last)))
    out = materialize(with_start.select("conv_id", "blk", acc.alias("acc"), F.transform("t", lambda x: x["chars"]).alias("chars")), "prefixes")
    for t in (held, starts):
        discard(t)
    return out


def _joint_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """The blocks of the trie of joints: conv_id, blk, acc."""
    k = F.col("blk") + 1
    joints = blocks.filter(F.size("acc") == size + 1).select("conv_id", k.alias("k"), F.element_at("acc", -1).alias("node"))
    own = joints.select("conv_id", F.floor((F.col("k") - 1) / size).alias("blk"), ((F.col("k") - 1) % size + 1).alias("pos"), "node")
    opens = joints.filter(F.col("k") % size == 0).select("conv_id", F.floor(F.col("k") / size).alias("blk"), F.lit(0).cast("long").alias("pos"), "node")
    acc = F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"])
    grouped = own.unionByName(opens).groupBy("conv_id", "blk").agg(acc.alias("acc"))
    root = F.array(F.lit(bytearray(ROOT)))
    return materialize(grouped.withColumn("acc", F.when(F.col("blk") == 0, F.concat(root, "acc")).otherwise(F.col("acc"))), "joint-blocks")


def subtree_sums(nodes: DataFrame, blocks: DataFrame, names: list[str], size: int = BLOCK) -> DataFrame:
    """node and the sums of the named columns over its subtree, itself included.

    nodes: depth, node, conv_id (any conversation through it) and the columns; the root has depth 0.
    blocks: conv_id, blk, acc as made by ``_blocks``.
    """
    sums = [F.sum(c).alias(c) for c in names]
    within = F.floor((F.col("depth") - 1) / size)
    placed = nodes.filter("depth > 0").withColumn("blk", within).join(blocks.select("conv_id", "blk", "acc"), ["conv_id", "blk"])
    up = placed.select(F.posexplode(F.slice("acc", F.lit(1), (F.col("depth") - F.col("blk") * size + 1).cast("int"))).alias("pos", "above"), *names)
    up = up.groupBy(F.col("above").alias("node"), (F.col("pos") == 0).alias("under")).agg(*sums)
    own = up.unionByName(nodes.filter("depth = 0").select("node", F.lit(False).alias("under"), *names))
    own = materialize(own, "within-blocks")
    inside, under = own.filter("not under").drop("under"), own.filter("under").drop("under")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    if deepest <= size:
        return inside.unionByName(under).groupBy("node").agg(*sums)
    where = nodes.filter(F.col("depth") % size == 0).select("node", "depth", "conv_id")
    joints = materialize(under.join(where, "node").withColumn("depth", F.floor(F.col("depth") / size)), "joints")
    below = materialize(subtree_sums(joints, _joint_blocks(blocks, size), names, size).join(where, "node"), "below-joints")
    placed = below.filter("depth > 0").withColumn("blk", within).join(blocks.select("conv_id", "blk", "acc"), ["conv_id", "blk"])
    carried = placed.select(F.explode(F.slice("acc", 2, size)).alias("node"), *names).unionByName(below.filter("depth = 0").select("node", *names))
    return inside.unionByName(carried).groupBy("node").agg(*sums)


@lean
def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads node and conv_id, sorted, and hashes each node's ids, comma-joined, as they come."""
    node, h = None, None
    for batch in batches:
        nodes, hashes = [], []
        for x, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if x != node:
                if h is not None:
                    nodes.append(node)
                    hashes.append(h.hexdigest())
                node, h = x, hashlib.sha256(b"%d" % c)
            else:
                h.update(b",%d" % c)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], ["node", "ends_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends_sha256"])


def trie(rows: DataFrame, convs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The nodes of the trie of all prefixes.

    rows: conv_id, d (1, 2, ... without gaps), td, chars. convs: conv_id, len of every conversation.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, (n_convs - 1) times the code points of each node's last text), ends_sha256.
    """
    batch_rows(rows.sparkSession, NUMBER_ROWS)
    blocks = _blocks(rows, size)
    each = F.expr(f"transform(sequence(1, size(chars)), j -> struct(blk * {size} + j as depth, acc[j] as node, acc[j - 1] as parent, chars[j - 1] as chars))")
    prefixes = blocks.select("conv_id", F.inline(each))
    members = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]
    nodes = prefixes.groupBy("depth", "node", "parent", "chars").agg(*members)  # a node has one parent and one last text
    root = convs.agg(*members).filter("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), F.lit(bytearray(ROOT)).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    nodes = materialize(nodes.unionByName(root), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}), "trie")
    sums = materialize(subtree_sums(nodes, blocks, ["n_leaves", "saved_tokens"], size), "subtrees")

    blk = F.floor((F.col("len") - 1) / size)
    last = convs.filter("len > 0").withColumn("blk", blk).join(blocks.select("conv_id", "blk", "acc"), ["conv_id", "blk"])
    last = last.select(F.element_at("acc", (F.col("len") - F.col("blk") * size + 1).cast("int")).alias("node"), "conv_id")
    last = last.unionByName(convs.filter("len = 0").select(F.lit(bytearray(ROOT)).alias("node"), "conv_id"))
    ends = materialize(last.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_ends, "node binary, ends_sha256 string"), "ends")
    batch_rows(rows.sparkSession, TEXT_ROWS)

    over = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(over, "parent", "left").join(sums, "node").join(ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


def oracle_sql(every: int = 100, most: int = 6) -> str:
    """DuckDB SQL for ``trie`` of ``shared_heads`` over conversations whose turns have numbers of their own: prefixes as texts."""
    bits = "flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(unicode(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT))"
    prefix = lambda n: f"array_to_string(list_slice(q, 1, {n}), chr(30))"
    return f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % {every} AS base, {crc} % {most} AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.n <= c.h UNION ALL SELECT c.conv_id, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h),
        g AS (SELECT conv_id, list(length(role) || ':' || role || text ORDER BY n) AS q, list(length(text) ORDER BY n) AS cs FROM r GROUP BY conv_id),
        s AS (SELECT c.conv_id, coalesce(g.q, []) AS q, coalesce(g.cs, []) AS cs FROM c LEFT JOIN g ON g.conv_id = c.conv_id),
        p AS (SELECT conv_id, q, cs, unnest(range(len(q) + 1)) AS d FROM s),
        k AS (SELECT conv_id, d, q, {prefix('d')} AS key, {prefix('d - 1')} AS up, CASE WHEN d = 0 THEN 0 ELSE cs[d] END AS chars FROM p),
        nodes AS (SELECT d, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, any_value(q) AS q FROM k GROUP BY d, key),
        kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, up),
        full_nodes AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.d = n.d AND kids.key = n.key),
        above AS (SELECT CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved, q, unnest(range(d + 1)) AS j FROM full_nodes),
        sums AS (SELECT j AS d, {prefix('j')} AS key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY j, {prefix('j')}),
        ends AS (SELECT len(q) AS d, {prefix('len(q)')} AS key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM s GROUP BY len(q), {prefix('len(q)')})
        SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(sums.n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
        FROM full_nodes n JOIN sums ON sums.d = n.d AND sums.key = n.key LEFT JOIN nodes o ON n.d > 0 AND o.d = n.d - 1 AND o.key = n.up LEFT JOIN ends e ON e.d = n.d AND e.key = n.key"""
