"""SimHash near-duplicates: fingerprints, links by pigeonring filtering, groups.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42) of a text's
three-word shingles, repeats included; a text of fewer words is one shingle, a text without
words has fingerprint zero. Fingerprints link at `distance` or fewer differing bits.

Candidates come from a ring of equal segments of the fingerprint. If two fingerprints differ in
at most d of m segments' bits, then from some segment on, every chain of l consecutive segments
around the ring differs in at most l * d / m bits. So the first `free` segments of that chain
are equal, and they are the key under which fingerprints meet; the rest of the chain is checked
before the full Hamming distance. Fingerprints are distinct there: copies were folded before.

A key under which more than `crowd` fingerprints meet is not paired. By the chain's budgets its
members differ in at most one bit until the budget reaches two, and in at most two bits at all,
so each of them is put under every fingerprint one bit away (and itself): two that link share
such a neighbour, and all that share one link, so a star in each suffices. That work is linear.

Null texts have no words. All texts without words link with each other. Rows that repeat a
document have its fingerprint and group. Documents with a null doc_id get a fingerprint and a
group, but never name one unless all of its ids are null.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import free_name, joined_to_one, marked, marks, same
from citegrain.plans.workdir import written

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 8
CROWD = 48
#: Hashes whose bits are counted at once, which bounds a very long text's memory.
BLOCK = 1 << 15


def simhash(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hash64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash64(s, SEED) for s in shingles), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        values = [simhash(t.as_py()) for t in batch.column("text")]
        signed = np.array(values, dtype=np.uint64).view(np.int64)
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(signed, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp, the fingerprint's 64 bits as a long, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, text_key bigint, fp bigint")


def _rotated(fp: Column, bits: int) -> Column:
    """The 64 bits turned left."""
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _chain_fits(diff: Column, segments: int, distance: int) -> Column:
    """Whether differing bits, turned so that the chain starts at the top, keep every prefix budget."""
    width, fits = 64 // segments, F.lit(True)
    for length in range(1, segments + 1):
        prefix = F.shiftrightunsigned(diff, 64 - length * width)
        fits = fits & (F.bit_count(prefix) <= length * distance // segments)
    return fits


def ring_fits(diff: Column, segments: int, distance: int) -> Column:
    """Whether some turn of the differing bits keeps every prefix budget, as those of two fingerprints within the distance do."""
    turns = [_chain_fits(_rotated(diff, i * (64 // segments)), segments, distance) for i in range(segments)]
    return functools.reduce(Column.__or__, turns)


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Links between distinct fingerprints, for rows of fp: a < b, both within the distance.

    Every two fingerprints within the distance are joined by a path of these links.
    """
    if distance != 2:
        raise ValueError("the crowded keys' way is for two differing bits")
    width = 64 // segments
    free = (segments + distance - 1) // distance - 1  # chains up to this long have no budget
    turned = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), _rotated(F.col("fp"), i * width).alias("ring")) for i in range(segments)]))
    keyed = fps.select("fp", turned.alias("t")).select(
        "fp", "t.start", "t.ring", F.shiftrightunsigned("t.ring", 64 - free * width).alias("key")
    )
    met = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1")
    few = keyed.join(met.filter(F.col("n") <= crowd).select("start", "key"), ["start", "key"])
    left = few.select("start", "key", F.col("fp").alias("a"), F.col("ring").alias("ring_a"))
    right = few.select("start", "key", F.col("fp").alias("b"), F.col("ring").alias("ring_b"))
    diff = F.col("ring_a").bitwiseXOR(F.col("ring_b"))
    pairs = left.join(right, ["start", "key"]).filter(
        (F.col("a") < F.col("b")) & _chain_fits(diff, segments, distance)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    ).select("a", "b")

    many = keyed.join(met.filter(F.col("n") > crowd).select("start", "key"), ["start", "key"]).select("fp").distinct()
    flips = [F.lit(0).cast("bigint")] + [F.shiftleft(F.lit(1).cast("bigint"), i) for i in range(64)]
    near = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("near"))
    hubs = near.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = near.join(hubs.select("near", "a"), "near").filter("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node that edges (a, b) lead to, for every node but the smallest.

    Alternating large and small stars: each round links a node's larger neighbours to its
    smallest, then its smaller ones, until all hang on one node.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        sums = [F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(38,0)")) for i in (1, 2)]
        state = edges.agg(F.count("*"), *sums).first()
        if state == before or not state[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # small star: v <= u neighbours and u itself to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).union(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = written(small.filter("x <> y").distinct().toDF("a", "b"))


def grouped(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document row: doc_id, text_key, fp, root (of the group), component_id (its smallest doc_id)."""
    rows = written(fingerprints(docs))
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), distance))
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(names, "root").select("fp", "root", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents that stay, with their columns: of each group the row of its smallest doc_id.

    Of rows with equal doc_ids in a group the one with the smallest text hash stays, and of rows
    that repeat doc_id and text one. A group whose ids are all null keeps one row.
    """
    return first_of_each(docs, grouped(docs, distance))


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each root of *groups* (doc_id, text_key, root) the row that `one_of_each` keeps.

    Only rows of groups of two or more (and the few that share their bits in a table of marks) are shuffled.
    """
    spark = docs.sparkSession
    rows = written(groups)
    best = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("k"))
    best = written(best.select("root", "n", "k.doc_id", "k.text_key"))
    row_key = lambda text_key: F.xxhash64("doc_id", text_key)
    several = best.filter("n > 1").select("root", "n")
    several = joined_to_one(rows, several, ["root"], several.withColumnRenamed("n", "held"), rows.count())
    table = marks(several.select(row_key("text_key").alias("row_key")), "row_key")
    keep_id, keep_key, key, mark = (free_name(docs, x) for x in ("keep_id", "keep_key", "text_key", "marked_row"))
    texts = docs.withColumn(key, F.xxhash64("text"))
    texts = texts.withColumn(mark, marked(spark, table, row_key(key)))
    alone, grouped_ = texts.filter(~F.col(mark)), texts.filter(F.col(mark))
    kept = best.select(F.col("doc_id").alias(keep_id), F.col("text_key").alias(keep_key))
    on = same(grouped_["doc_id"], kept[keep_id]) & (grouped_[key] == kept[keep_key])
    first = grouped_.join(kept.hint("shuffle_hash"), on, "left_semi").dropDuplicates(["doc_id", key])
    return alone.unionByName(first).drop(key, mark)
