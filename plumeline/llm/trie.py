"""Totals of a prefix trie of sequences, by parallel tree contraction.

A prefix is known by its depth and sums of hashes of its elements with their places (128 bits and more),
so that prefixes are running sums, which split over parts of a long sequence. The trie's subtree totals
come from contraction: a round rakes all leaves, adding their sums to their parents, and compresses
unary chains, splicing out every second of their nodes. Rounds go with the logarithm of the number of
nodes, however deep the trie. Then the rounds are gone through backwards: a spliced node's total is that of the
node below it and what stood between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Elements of a sequence that are summed in one group; longer sequences take several.
RUN = 4096
#: Bytes of joined ids in one row before they are hashed.
BLOB_BYTES = 1 << 20
HASHES = ("g1", "g2", "g3", "g4")
ROOT = -1


def numbered(rows: DataFrame, key: str, order: list[str], scratch: Scratch) -> DataFrame:
    """rows (key, *order) with pos, each row's place (from 1) among those of its key, nulls first.

    Rows are parted by ranges of key and order, so a key with very many rows is several parts; places
    are counted inside parts, and a part's offset is the sum of the parts before it. Equal rows are
    counted before they are parted and dealt out after.
    """
    kinds = rows.groupBy(key, *order).agg(F.count("*").alias("copies"))
    ranged = kinds.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id())
    ranged = scratch.write(ranged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies"), "ranged")
    sums = ranged.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = sums.withColumn("before", before).where("before > 0").select(key, "part", "before")
    place = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order, "copy"))
    return ranged.withColumn("place", place).join(offset, [key, "part"], "left").select(key, *order, (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, pos, size, g1..g4, p1..p4): sums of hashes up to an element, and up to the one before."""
    one, two = F.xxhash64("pos", "role", "text"), F.xxhash64(F.lit(1), "pos", "role", "text")
    low = F.lit(0xFFFFFFFF)
    own = [one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32)]
    each = turns.select("conv", "pos", F.length("text").cast("long").alias("size"), F.expr(f"pos div {RUN}").alias("run"), *(x.alias(f"o{i}") for i, x in enumerate(own, 1)))
    up_to = Window.partitionBy("conv", "run").orderBy("pos")
    local = each.select("*", *(F.sum(f"o{i}").over(up_to).alias(f"l{i}") for i in range(1, 5)))
    sums = each.groupBy("conv", "run").agg(*(F.sum(f"o{i}").alias(f"s{i}") for i in range(1, 5)))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("conv", "run", *(F.sum(f"s{i}").over(earlier).alias(f"b{i}") for i in range(1, 5))).where("b1 is not null")
    whole = [F.col(f"l{i}") + F.coalesce(f"b{i}", F.lit(0)) for i in range(1, 5)]
    return local.join(offset, ["conv", "run"], "left").select("conv", "pos", "size", *(h.alias(f"g{i}") for i, h in enumerate(whole, 1)), *((h - F.col(f"o{i}")).alias(f"p{i}") for i, h in enumerate(whole, 1)))


def _digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, digest): SHA-256 of each node's ids (node, conv), ascending, joined by commas.

    Ids are sorted by ranges of node and id and joined to rows of at most BLOB_BYTES; the digest of a
    node reads its rows one after the other, as that digest cannot be parted.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = first = None
        parts, size = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(parts).encode()], pa.binary())], ["node", "first", "ids"])

        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if parts and (n != node or size > BLOB_BYTES):
                    yield row()
                    parts, size = [], 0
                if not parts:
                    node, first = n, c
                parts.append(str(c))
                size += len(parts[-1]) + 1
        if parts:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for batch in batches:
            nodes, out = [], []
            for n, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n == node:
                    h.update(b",")
                elif h is not None:
                    nodes.append(node)
                    out.append(h.hexdigest())
                if n != node:
                    node, h = n, hashlib.sha256()
                h.update(body)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.string())], ["node", "digest"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([h.hexdigest()])], ["node", "digest"])

    rows = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(join, "node long, first long, ids binary")
    rows = scratch.write(rows, "ids")
    return rows.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node long, digest string")


def _coin(depth: str, k: int) -> Column:
    """Chains have successive depths: the k-th bit picks every second node of what k rounds have left."""
    return F.shiftright(depth, k % 20).bitwiseAND(1) == 1


def subtree_sums(tree: DataFrame, sums: list[str], scratch: Scratch) -> DataFrame:
    """(node, *sums) summed over each node's subtree. tree: node, up (null: a root), depth, *sums."""
    own, carried = [f"a_{s}" for s in sums], [f"c_{s}" for s in sums]
    live = scratch.write(tree.select("node", "up", "depth", *(F.col(s).alias(f"a_{s}") for s in sums), *(F.lit(0).cast("long").alias(c) for c in carried)), "live0")
    raked, spliced, k = [], [], 0
    while True:
        parents = live.where("up is not null").select(F.col("up").alias("node")).distinct()
        marked = scratch.write(live.join(parents.withColumn("inner", F.lit(True)), "node", "left"), f"marked{k}")
        leaves, inner = marked.where("inner is null"), marked.where("inner").drop("inner")
        raked.append(leaves.select("node", *(F.col(a).alias(s) for a, s in zip(own, sums, strict=True))))
        given = leaves.where("up is not null").groupBy("up").agg(*(F.sum(F.col(f"a_{s}") + F.col(f"c_{s}")).alias(f"g_{s}") for s in sums)).withColumnRenamed("up", "node")
        fed = inner.join(given, "node", "left").select("node", "up", "depth", *((F.col(f"a_{s}") + F.coalesce(f"g_{s}", F.lit(0))).alias(f"a_{s}") for s in sums), *carried)
        fed = scratch.write(fed, f"fed{k}")
        if fed.isEmpty():
            break
        below = fed.where("up is not null").groupBy("up").agg(F.count("*").alias("n"), F.min("node").alias("child")).where("n = 1").select(F.col("up").alias("node"), "child")
        picked = fed.where(F.col("up").isNotNull() & _coin("depth", k)).join(below, "node")
        picked = scratch.write(picked.join(picked.select(F.col("node").alias("child")), "child", "left_anti"), f"picked{k}")
        over = picked.select(F.col("child").alias("node"), F.col("node").alias("gone"), F.col("up").alias("above"), *(F.col(f"a_{s}").alias(f"pa_{s}") for s in sums), *(F.col(f"c_{s}").alias(f"pc_{s}") for s in sums))
        joined = fed.join(picked.select("node"), "node", "left_anti").join(over, "node", "left")
        put = F.col("gone").isNotNull()
        joined = scratch.write(joined, f"joined{k}")
        spliced.append(joined.where(put).select(F.col("gone").alias("node"), F.col("node").alias("child"), *((F.col(f"pa_{s}") + F.col(f"c_{s}")).alias(f"x_{s}") for s in sums)))
        k += 1
        live = joined.select("node", F.when(put, F.col("above")).otherwise(F.col("up")).alias("up"), "depth", *own, *(F.when(put, F.col(f"c_{s}") + F.col(f"pa_{s}") + F.col(f"pc_{s}")).otherwise(F.col(f"c_{s}")).alias(f"c_{s}") for s in sums))
    done = raked[-1]
    for j in reversed(range(len(spliced))):  # what was live after round j has its totals
        again = spliced[j].join(done.withColumnRenamed("node", "child"), "child").select("node", *((F.col(s) + F.col(f"x_{s}")).alias(s) for s in sums))
        done = scratch.write(done.union(raked[j]).union(again), f"done{j}")
    return done


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node.

    turns: (conv, pos, role, text), pos from 1 without gaps in each conv; null role or text counts as empty. members: (conv) of
    every sequence, empty ones too. A node is a distinct sequence of first turns and is named by its least
    member and its depth; the root has depth 0 and no parent. n_leaves and saved_tokens are sums over the
    node's subtree, itself included: childless nodes, and (members - 1) times the code points of the last
    text. ends_sha256 is the SHA-256 of the ids of those members that end there. Without members there are
    no nodes. Nothing is gathered by sequence or by node but running sums of at most RUN elements.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    members = scratch.write(members.select("conv").where("conv is not null").distinct(), "members")
    turns = turns.select("conv", "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    prefixes = scratch.write(_prefixes(turns), "prefixes")
    parents = [f"p{i}" for i in range(1, 5)]
    nodes = prefixes.groupBy("pos", *HASHES).agg(F.min("conv").alias("name"), F.count("*").alias("n_convs"), F.max("size").alias("size"), *(F.min(p).alias(p) for p in parents))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    root = members.agg(F.min("conv").alias("name"), F.count("*").alias("n_convs")).where("n_convs > 0")
    above = nodes.select((F.col("pos") + 1).alias("pos"), *(F.col(g).alias(p) for g, p in zip(HASHES, parents, strict=True)), F.col("node").alias("up"), F.col("name").alias("parent"))
    inner = nodes.where("pos > 1").join(above, ["pos", *parents])
    top = nodes.where("pos = 1").crossJoin(F.broadcast(root.select(F.col("name").alias("parent"))))
    columns = ["node", "up", "pos", "name", "parent", "n_convs", "size"]
    tree = inner.select(*columns).union(top.withColumn("up", F.lit(ROOT).cast("long")).select(*columns))
    tree = tree.union(root.select(F.lit(ROOT).cast("long"), F.lit(None).cast("long"), F.lit(0).cast("long"), "name", F.lit(None).cast(root.schema["name"].dataType), "n_convs", F.lit(0).cast("long")))
    tree = scratch.write(tree, "tree")
    children = tree.where("up is not null").groupBy("up").agg(F.count("*").alias("n_children")).withColumnRenamed("up", "node")
    tree = scratch.write(tree.join(children, "node", "left").fillna(0, ["n_children"]), "counted")
    weights = tree.select("node", "up", F.col("pos").cast("long").alias("depth"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    totals = subtree_sums(weights, ["n_leaves", "saved_tokens"], scratch)
    last = prefixes.groupBy("conv").agg(F.max("pos").alias("pos"))
    at_end = prefixes.join(last, ["conv", "pos"]).select("conv", "pos", *HASHES).join(nodes.select("node", "pos", *HASHES), ["pos", *HASHES]).select("node", "conv")
    turnless = members.join(last, "conv", "left_anti").select(F.lit(ROOT).cast("long").alias("node"), "conv")
    digests = _digests(at_end.union(turnless), scratch)
    return tree.join(totals, "node").join(digests, "node", "left").select(
        F.col("name").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
