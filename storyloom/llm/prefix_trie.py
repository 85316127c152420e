"""Conversation prefix trie by time-forward processing (operator 12).

A node is a distinct sequence of first turns; its key is made of two running xors of 64-bit hashes of (place, role and text), so nodes are found by
one aggregate over (conversation, depth) rows and never by comparing texts or by walking levels with joins.

Totals over subtrees go from the leaves to the root. Nodes with more than ``shard_convs`` member conversations are heavy; what hangs below
them, a subtree of at most that many conversations each, is a shard. Shards are dealt to tasks, the nodes of a task are sorted by Spark's
external sort in reverse level order, and each node, as it comes, takes the messages that its children have put into a priority queue for
it and puts one in for its parent. The queue keeps a bounded heap and spills sorted runs to unnamed files of the task. The totals of the shards' roots are
summed for each heavy parent, and the heavy nodes, at most 1,000 a level by default, pass them on in the same way to the root.

No task holds a conversation, a node's members or its children: running sums come from window frames that spill, the digest of the ends of a node
goes over blocks of ids which are joined in tasks of any range first, and only the serial hash of those blocks runs in one task for a node.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import Scratch, hot_rows, join_hot, stored
from .scratch import broadcast_if_small

QUEUE_ITEMS = 500_000
BLOCK_CHARS = 1 << 16
KEY = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, content, chars): turns in order (null turns first, equal ones by the MD5 of their content), with that MD5 and the code points
    of the text. Null roles and texts are empty, rows with a null conv_id go, repeated rows are turns of their own, other columns are ignored."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), content.alias("content"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "content")
    return rows.withColumn("rank", F.row_number().over(order)).select("conv_id", "rank", "content", "chars")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns (conv_id, depth, content, chars), conversations (conv_id, n_turns)): every conversation with its first h turns replaced by the first h,
    or all if fewer, of the first conversation of its block of ids; h is the crc32 of its id modulo ``most``."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    convs = own.select("conv_id", "n_own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "k", (F.greatest(F.col("n_own") - F.col("h"), F.lit(0)) + F.col("k")).alias("n_turns"))
    heads = turns.where(F.col("rank") < most).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").where("rank <= h").select("conv_id", F.col("rank").cast("long").alias("depth"), "content", "chars")
    kept = turns.join(convs.select("conv_id", "h", "k"), "conv_id").where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("k")).alias("depth"), "content", "chars")
    return taken.unionByName(kept), convs.select("conv_id", "n_turns")


class SpillingQueue:
    """Tuples of whole numbers, the least first: a heap of at most ``limit`` items, of which the later half goes to a file as a sorted run if it
    is full. Runs are read back in blocks. The files have no name and go with the task, like the spills of Spark's own sorter."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width, self.heap, self.runs = max(limit, 2), width, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            keep = self.limit // 2
            file = tempfile.TemporaryFile()  # noqa: SIM115
            np.array(self.heap[keep:], dtype=np.int64).tofile(file)
            file.seek(0)
            del self.heap[keep:]
            run = self._read(file)
            heapq.heappush(self.runs, (next(run), id(run), run))

    def _read(self, file):
        while len(block := np.fromfile(file, dtype=np.int64, count=8192 * self.width)):
            yield from map(tuple, block.reshape(-1, self.width).tolist())
        file.close()

    def peek(self) -> tuple | None:
        best = self.heap[0] if self.heap else None
        return self.runs[0][0] if self.runs and (best is None or self.runs[0][0] < best) else best

    def pop(self) -> tuple:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        item, number, run = self.runs[0]
        if (after := next(run, None)) is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (after, number, run))
        return item


def _forward(limit: int):
    """Nodes in reverse level order: each takes what its children sent and sends its totals to its parent, unless it is the top of its shard."""

    def run(batches):
        queue = SpillingQueue(limit, 6)
        for batch in batches:
            column = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            rows = zip(*(column[c] for c in ("depth", "k1", "k2", "u1", "u2", "cost", "top", "n_children", "n_leaves", "saved_tokens")), strict=True)
            totals = []
            for depth, k1, k2, u1, u2, cost, top, children, leaves, saved in rows:
                here = (-depth, k1, k2)
                while (m := queue.peek()) is not None and m[:3] == here:
                    _, _, _, a, b, c = queue.pop()
                    children, leaves, saved = children + a, leaves + b, saved + c
                leaves, saved = leaves or 1, saved + cost
                if not top:
                    queue.push((1 - depth, u1, u2, 1, leaves, saved))
                totals.append((children, leaves, saved))
            done = [pa.array(list(c), pa.int64()) for c in zip(*totals, strict=True)] or [pa.array([], pa.int64())] * 3
            names = [*KEY, "u1", "u2", "conv_id", "n_convs", "top"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in names), *done], names=[*names, "n_children", "n_leaves", "saved_tokens"])
        if queue.peek() is not None:
            raise RuntimeError("a node of a shard has no parent in it")

    return run


FORWARD = "depth long, k1 long, k2 long, u1 long, u2 long, conv_id long, n_convs long, top boolean, n_children long, n_leaves long, saved_tokens long"


def _blocks(batches):
    """Ids of a node that follow each other in a sorted partition, joined up to some length: (depth, k1, k2, first id, text)."""
    node, first, text, size = None, None, [], 0
    rows: list = []

    def out():
        made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=[*KEY, "first", "ids"])
        rows.clear()
        return made

    for batch in batches:
        for *here, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here != node or size > BLOCK_CHARS:
                if text:
                    rows.append((*node, first, ",".join(text)))
                    if len(rows) >= 1024:
                        yield out()
                node, first, text, size = here, conv_id, [], 0
            text.append(str(conv_id))
            size += len(text[-1]) + 1
    if text:
        rows.append((*node, first, ",".join(text)))
    if rows:
        yield out()


def _digests(batches):
    """(depth, k1, k2, SHA-256 of the blocks of a node, comma-joined) of a partition sorted by node and first id."""
    node, digest, rows = None, None, []

    def out():
        made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 3 + (pa.string(),), strict=True)], names=[*KEY, "ends_sha256"])
        rows.clear()
        return made

    for batch in batches:
        for *here, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if here == node:
                digest.update(b",")
            else:
                if node:
                    rows.append((*node, digest.hexdigest()))
                    if len(rows) >= 4096:
                        yield out()
                node, digest = here, hashlib.sha256()
            digest.update(ids.encode())
    if node:
        rows.append((*node, digest.hexdigest()))
    if rows:
        yield out()


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes that a conversation of ``ends`` (depth, k1, k2, conv_id) ends in."""
    ranged = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    blocks = ranged.mapInArrow(_blocks, "depth long, k1 long, k2 long, first long, ids string")
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_convs: int | None = None, queue_items: int = QUEUE_ITEMS) -> DataFrame:
    """One row for each distinct sequence of first turns of the conversations, the empty one included: conv_id (the least member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, depth (1, 2, ... without gaps), content (binary), chars; ``convs``: conv_id (distinct), n_turns. ``saved_tokens`` sums over the
    subtree of a node what sharing it saves: its members but one, times the code points of its last text. Ids are taken as they are, so equal
    conversations are members of the same nodes. Without conversations there is no root. ``shard_convs`` is by default a thousandth of
    all conversations, and 1,000 at least.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    convs = scratch.put(convs, "convs")
    total = convs.count()
    most = shard_convs or max(1_000, -(-total // 1_000))
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    # a node's key without its last turn is its parent's
    lanes = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "chars", F.xxhash64("depth", "content").alias("l1"), F.xxhash64(F.lit("b"), "content", "depth").alias("l2"))
    keyed = lanes.select("conv_id", "depth", "chars", "l1", "l2", F.bit_xor("l1").over(so_far).alias("k1"), F.bit_xor("l2").over(so_far).alias("k2"))
    paths = scratch.put(keyed.select("conv_id", "depth", "chars", "k1", "k2", F.col("k1").bitwiseXOR(F.col("l1")).alias("u1"), F.col("k2").bitwiseXOR(F.col("l2")).alias("u2")), "paths")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.max(c).alias(c) for c in ("chars", "u1", "u2")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"), none.alias("u1"), none.alias("u2"))
    cost = (F.col("n_convs") - 1) * F.col("chars")
    nodes = scratch.put(nodes.unionByName(root).select(*KEY, "u1", "u2", "conv_id", "n_convs", cost.alias("cost"), *(zero.alias(c) for c in ("n_children", "n_leaves", "saved_tokens"))), "nodes")
    ends = paths.join(convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select(*KEY, "conv_id")
    ends = ends.unionByName(convs.where("n_turns = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    digests = scratch.put(_end_digests(ends), "ends")

    # the shard of a light node is named by the first light node on the path of its least member
    heavy = nodes.where(F.col("n_convs") > most)
    light = nodes.where(F.col("n_convs") <= most)
    if total > most:
        upper = paths.join(broadcast_if_small(heavy.select(*KEY)), KEY, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("above"))
        tops = convs.select("conv_id").join(upper, "conv_id", "left").select("conv_id", (F.coalesce("above", zero) + 1).alias("depth"))
        shard = paths.join(tops, ["conv_id", "depth"]).select("conv_id", F.col("k1").alias("s1"), F.col("k2").alias("s2"))
        light = light.join(shard, "conv_id")
    else:
        light = light.withColumn("s1", zero).withColumn("s2", zero)
    light = light.withColumn("top", (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).repartition("s1", "s2").sortWithinPartitions(F.desc("depth"), "k1", "k2")
    light = scratch.put(light.drop("s1", "s2").mapInArrow(_forward(queue_items), FORWARD), "shards")
    sent = light.where("top and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upper = heavy.drop("n_children", "n_leaves", "saved_tokens").join(sent, KEY, "left").fillna(0, ["n_children", "n_leaves", "saved_tokens"]).withColumn("top", F.col("depth") == 0)
    upper = upper.repartition(1).sortWithinPartitions(F.desc("depth"), "k1", "k2").mapInArrow(_forward(queue_items), FORWARD)
    done = scratch.put(light.unionByName(upper), "totals")

    parents = done.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), "n_children").where("n_children > 0")
    hot = parents.where(F.col("n_children") > hot_rows(done.count()))
    out = join_hot(done.where("depth > 0"), parents.drop("n_children"), ["depth", "u1", "u2"], hot).unionByName(done.where("depth = 0").withColumn("parent_conv_id", none))
    out = out.join(digests, KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    out = stored(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")), "prefix-trie")
    scratch.close()
    return out
