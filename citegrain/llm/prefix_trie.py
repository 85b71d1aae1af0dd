"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns (role, text). It is named by its depth and the exclusive or of
two 64-bit hashes of each (place, turn digest) along it, which adds up in any grouping: a conversation of any
length is numbered and hashed in blocks of at most `BLOCK` turns, and texts leave the job with the first step.
Digests are MD5 of the turn, so nodes are equal if 128 bits are.

Every node is (smallest member, depth), and its parent's pair comes before its own in that order. Totals of
subtrees go up by time-forward processing: ranges of that order are the shards, of about `SHARD_ROWS` nodes each. In a
shard the nodes come in reverse level order, and each sends its total to its parent through a priority queue
that is read when the parent is reached. A total whose parent lies in an earlier shard leaves as a row, where Spark's
shuffle spills it; the queue itself holds at most one message for each node of the shard.
The nodes that receive such rows, with the first node outside the shard above each, are a smaller forest of
the same kind: its totals are found in the same way, in as many levels as it takes to fit one shard,
and then every shard is run once more with what reaches it from outside.

Conversations are ordered by turn, null first; equal turns go by the digest of the turn, rows repeated in full are
turns of their own. Null role and text are empty. Rows without a conv_id belong to no conversation. Texts
of any length are hashed and counted whole. An empty table has no nodes. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.plans.workdir import written

#: Turns of a conversation that are numbered or hashed in one window.
BLOCK = 4096
#: Nodes, or rows of the order, that a task takes at once.
SHARD_ROWS = 1 << 16
#: Conversation ids that are joined to one string before their node's digest is made.
IDS = 2048
#: At most so many nodes have their children dealt out over several tasks.
HOT = 1 << 16

KEY = ["depth", "id1", "id2"]


def numbered(turns: DataFrame, part_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id, pos (from 1), digest and chars of every turn, written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary"))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("bigint").alias("chars")
    )
    rows = rows.groupBy("conv_id", "turn", "digest", "chars").agg(F.count("*").alias("n"))
    rows = written(rows.select("conv_id", "turn", "digest", "chars", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy")))
    order = ["turn", "digest", "copy"]
    ranges = rows.repartitionByRange(max(1, math.ceil(rows.count() / part_rows)), "conv_id", *order)
    ranges = written(ranges.withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    bases = bases.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    rows = ranges.withColumn("at", inside).join(bases, ["conv_id", "part"])
    return written(rows.select("conv_id", (F.col("at") + F.col("base")).alias("pos"), "digest", "chars"))


def rebuilt(rows: DataFrame, donor: Column, head: Column) -> DataFrame:
    """Every conversation with its first *head* turns exchanged for those of conversation *donor*, written.

    Both are expressions of conv_id. All of a donor's turns go if it has fewer, none if it is absent. A conversation
    that is left without turns has one row, with pos 0.
    """
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("donor", donor).withColumn("head", head.cast("bigint"))
    lengths = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("given"))
    convs = convs.join(lengths, "donor", "left").withColumn("given", F.least("head", F.coalesce("given", F.lit(0))))
    convs = written(convs.select("conv_id", "donor", "head", "n", "given"))
    block = lambda pos: F.floor((pos - 1) / BLOCK)
    dealt = convs.select("conv_id", "head", "given", F.explode(F.sequence(F.lit(0).cast("bigint"), block(F.col("n")))).alias("block"))
    own = rows.filter(F.col("pos") > head).withColumn("block", block(F.col("pos"))).join(dealt, ["conv_id", "block"])
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), "digest", "chars")
    most = convs.agg(F.max("given")).first()[0] or 0
    heads = rows.filter(F.col("pos") <= most).withColumnRenamed("conv_id", "donor")
    given = convs.filter("given > 0").select("conv_id", "donor", "given").join(heads, "donor").filter("pos <= given")
    given = given.select("conv_id", "pos", "digest", "chars")
    none = convs.filter((F.col("given") == 0) & (F.col("n") <= F.col("head")))
    none = none.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("chars"))
    return written(own.unionByName(given).unionByName(none))


def members(rows: DataFrame) -> DataFrame:
    """conv_id, chars and node (depth, id1, id2) with its parent's name (up1, up2) for every prefix of every conversation."""
    block = F.floor((F.greatest(F.col("pos"), F.lit(1)) - 1) / BLOCK)
    own = lambda salt: F.when(F.col("pos") > 0, F.xxhash64(F.lit(salt), "digest", "pos")).otherwise(0)
    rows = rows.select("conv_id", "chars", F.col("pos").alias("depth"), block.alias("block"), own(1).alias("f1"), own(2).alias("f2"))
    totals = rows.groupBy("conv_id", "block").agg(F.bit_xor("f1").alias("t1"), F.bit_xor("f2").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    bases = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), zero).alias(f"b{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.bit_xor(f"f{i}").over(inside).alias(f"r{i}") for i in (1, 2)]).join(bases, ["conv_id", "block"])
    for i in (1, 2):
        rows = rows.withColumn(f"id{i}", F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}"))).withColumn(f"up{i}", F.col(f"id{i}").bitwiseXOR(F.col(f"f{i}")))
    rows = rows.filter("depth > 0").select("conv_id", "chars", *KEY, "up1", "up2")
    return rows


def _digests(ends: DataFrame) -> DataFrame:
    """The node (depth, id1, id2) and ends_sha256 for rows of node and conv_id."""
    key = "depth bigint, id1 bigint, id2 bigint"

    def joined(batches):
        held, ids = None, []
        row = lambda: pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64()) for x in (*held, ids[0])] + [pa.array([",".join(map(str, ids))])], names=[*KEY, "first", "ids"]
        )
        for batch in batches:
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id"))):
                if ids and (node != held or len(ids) == IDS):
                    yield row()
                    ids = []
                held = node
                ids.append(conv)
        if ids:
            yield row()

    def hashed(batches):
        held, state = None, None
        row = lambda: pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64()) for x in held] + [pa.array([state.hexdigest()])], names=[*KEY, "ends_sha256"]
        )
        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if node == held:
                    state.update(b"," + ids.encode())
                    continue
                if held is not None:
                    yield row()
                held, state = node, hashlib.sha256(ids.encode())
        if held is not None:
            yield row()

    runs = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    runs = runs.select(*KEY, "conv_id").mapInArrow(joined, f"{key}, first bigint, ids string")
    runs = runs.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return runs.select(*KEY, "ids").mapInArrow(hashed, f"{key}, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with n_children and the parent's conv_id. The children of a node with very many are dealt over several tasks."""
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("id1"), F.col("up2").alias("id2"))
    kids = kids.agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))
    share = max(BLOCK, math.ceil(nodes.count() / HOT))  # so at most HOT nodes have more children than this
    deals = F.ceil(F.col("n_children") / share)
    up = [F.col("depth").alias("up_depth"), F.col("id1").alias("up1"), F.col("id2").alias("up2")]
    hot = nodes.filter(F.col("n_children") > share).select(*up, deals.alias("deals"))
    rows = nodes.withColumn("up_depth", F.col("depth") - 1).join(F.broadcast(hot), ["up_depth", "up1", "up2"], "left")
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("conv_id"), F.coalesce("deals", F.lit(1)))).drop("deals")
    parents = nodes.filter("n_children > 0").select(
        *up, F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), deals - 1)).alias("deal")
    )
    return written(rows.join(parents, ["up_depth", "up1", "up2", "deal"], "left").drop("up_depth", "up1", "up2", "deal"))


def forwarded(rows: list[tuple]) -> tuple[list[tuple[int, int]], dict, list]:
    """One shard: totals, what goes to parents outside, and the first node outside above each.

    *rows* are (conv_id, depth, up_conv_id, up_depth, leaves, saved) in reverse level order: by depth from the
    deepest, then by conv_id.
    """
    first = min((r[0], r[1]) for r in rows)
    inside = lambda r: r[2] is not None and (r[2], r[3]) >= first
    queue: list[tuple[int, int, int, int]] = []
    totals, out = [], defaultdict(lambda: [0, 0])
    for r in rows:
        conv, depth, up_conv, up_depth, leaves, saved = r
        while queue and queue[0][:2] == (-depth, conv):
            _, _, x, y = heapq.heappop(queue)
            leaves, saved = leaves + x, saved + y
        totals.append((leaves, saved))
        if inside(r):
            heapq.heappush(queue, (-up_depth, up_conv, leaves, saved))
        elif up_conv is not None:
            sent = out[up_conv, up_depth]
            sent[0], sent[1] = sent[0] + leaves, sent[1] + saved
    above, beyond = {}, [None] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        beyond[i] = above[r[2], r[3]] if inside(r) else (r[2], r[3])
        above[r[0], r[1]] = beyond[i]
    return totals, out, beyond


NODE = ["conv_id", "depth", "up_conv_id", "up_depth", "leaves", "saved"]


def _shards(batches):
    """Rows of NODE, one list for each shard, from batches sorted by shard."""
    held, rows = None, []
    for batch in batches:
        for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", *NODE))):
            if shard != held and rows:
                yield rows
                rows = []
            held = shard
            rows.append(tuple(row))
    if rows:
        yield rows


def _table(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _outbound(batches):
    """Messages to nodes outside (is_message 1), and for every node the first one outside above it."""
    names = ["is_message", "conv_id", "depth", "up_conv_id", "up_depth", "leaves", "saved"]
    for rows in _shards(batches):
        _, out, beyond = forwarded(rows)
        if out:
            n = len(out)
            yield _table([[1] * n, *zip(*out), [None] * n, [None] * n, *zip(*out.values())], names)
        yield _table([[0] * len(rows), *zip(*((r[0], r[1], *b, 0, 0) for r, b in zip(rows, beyond)))], names)


def _inbound(batches):
    for rows in _shards(batches):
        totals, _, _ = forwarded(rows)
        yield _table(list(zip(*((r[0], r[1], *t) for r, t in zip(rows, totals)))), ["conv_id", "depth", "leaves", "saved"])


def subtree_totals(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id, depth and the sums of leaves and saved over each node's subtree, for rows of NODE."""
    n = nodes.count()
    sharded = nodes.repartitionByRange(max(1, math.ceil(n / shard_rows)), "conv_id", "depth")
    sharded = written(sharded.select(*NODE, F.spark_partition_id().alias("shard")))
    shards = (sharded.agg(F.max("shard")).first()[0] or 0) + 1
    dealt = lambda rows: rows.repartitionById(shards, "shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id").select("shard", *NODE)
    if shards > 1:
        schema = "is_message int, conv_id bigint, depth bigint, up_conv_id bigint, up_depth bigint, leaves bigint, saved bigint"
        sent = written(dealt(sharded).mapInArrow(_outbound, schema.replace("is_message int", "is_message bigint")))
        sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
        entries = sent.filter("is_message = 1").groupBy("conv_id", "depth").agg(*sums)
        beyond = sent.filter("is_message = 0").select("conv_id", "depth", "up_conv_id", "up_depth")
        entries = written(entries.join(beyond, ["conv_id", "depth"]).select(*NODE))
        if not entries.isEmpty():
            reached = subtree_totals(entries, shard_rows).toDF("conv_id", "depth", "more_leaves", "more_saved")
            rows = sharded.join(reached, ["conv_id", "depth"], "left")
            for c in ("leaves", "saved"):
                rows = rows.withColumn(c, F.col(c) + F.coalesce(f"more_{c}", F.lit(0)))
            sharded = rows.drop("more_leaves", "more_saved")
    return dealt(sharded).mapInArrow(_inbound, "conv_id bigint, depth bigint, leaves bigint, saved bigint")


def trie(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the conversations in *rows* (of `rebuilt` or `numbered`): conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    deep = written(members(rows))
    convs = rows.groupBy("conv_id").agg(F.count("*"))
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv_id", *[zero.alias(c) for c in ("chars", *KEY, "up1", "up2")])
    every = deep.unionByName(root)
    nodes = every.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("up1").alias("up1"), F.max("up2").alias("up2")
    )
    nodes = _with_parents(nodes)
    last = every.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("k")).select("conv_id", "k.*")
    own = nodes.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("up_conv_id"), F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth"),
        (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    totals = subtree_totals(own, shard_rows).toDF("conv_id", "depth", "n_leaves", "saved_tokens")
    out = nodes.join(_digests(last), KEY, "left").join(totals, ["conv_id", "depth"])
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
