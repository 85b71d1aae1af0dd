"""Sharding into contiguous key ranges of near equal bytes, by histogram sort.

The key of a row is the MD5 of its text and then the MD5 of its doc_id, both in hex: rows with
equal texts are neighbours. A group of equal texts stays whole if it holds at most `WHOLE` of a shard's
bytes; a larger one is split between doc_ids. Splitters are looked for as hex prefixes of that key. Each round counts
the exact bytes of every probe (the next digits below the prefixes still open), takes a probe
as splitter once the bytes below it are within the tolerance of the ideal, and refines the
others; a splitter whose range has come down to one key takes its nearer side. Rows are
exchanged once, when all splitters are known.

A row's size is its UTF-8 bytes plus 1 (null text: 1). Null texts share one key prefix of their
own. Rows that repeat both doc_id and text are folded to a count and told apart by a copy number, whose MD5 ends
the key, so that any number of them can be split. An empty table has no splitters. Slots number each shard's rows without
gaps from 0. Texts of any length are hashed whole. Other columns are passed on or ignored, whatever their names.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.common import free_name
from citegrain.plans.workdir import written

TOLERANCE = 0.002
WHOLE = 0.02
TEXT_DIGITS = 32
#: Hex digits that a round adds: 16 ** 3 probes below each open prefix.
DIGITS = 3
#: Copies of one row that a task puts out.
COPIES = 1 << 16


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def key_of(text: Column, doc_id: Column) -> Column:
    of_text = F.coalesce(F.md5(text.cast("binary")), F.lit("0" * TEXT_DIGITS))
    return F.concat(of_text, F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")))


def splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[str]:
    """The keys at which shards 1 and up begin, for rows of key and size."""
    wanted: dict[int, float] | None = None
    total, slack, found = 0, 0.0, {}
    open_ = {"": 0}  # prefix -> bytes below it; at most one for each splitter
    while open_:
        key = F.col("key")
        probe = F.coalesce(*[F.when(key.startswith(p), F.substring(key, 1, len(p) + DIGITS)) for p in open_])
        counted = sizes.select(probe.alias("probe"), "key", "size").filter(F.col("probe").isNotNull())
        bins = counted.groupBy("probe").agg(
            F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last")
        ).orderBy("probe").collect()  # at most 16 ** DIGITS for each open prefix
        if wanted is None:
            total = sum(b["bytes"] for b in bins)
            wanted = {i: total * i / shards for i in range(1, shards)} if total else {}
            slack = tolerance * total / shards
        refined = {}
        for i, ideal in wanted.items():
            if i in found:
                continue
            for prefix, base in open_.items():
                own = [b for b in bins if b["probe"].startswith(prefix)]
                if not base <= ideal <= base + sum(b["bytes"] for b in own):
                    continue
                below, n = base, 0
                while below + own[n]["bytes"] < ideal:
                    below, n = below + own[n]["bytes"], n + 1
                b = own[n]
                under, over = ideal - below, below + b["bytes"] - ideal
                one_text = b["first"][:TEXT_DIGITS] == b["last"][:TEXT_DIGITS]
                small = one_text and b["bytes"] <= WHOLE * total / shards
                if min(under, over) <= slack or small or b["first"] == b["last"]:
                    found[i] = b["first"] if under <= over else own[n + 1]["first"] if n + 1 < len(own) else b["last"] + "~"
                else:  # all its keys start alike as far as its first and last key do
                    refined[os.path.commonprefix([b["first"], b["last"]])] = below
                break
        open_ = refined
    return [found[i] for i in sorted(found)]


def shard_of(key: Column, starts: list[str]) -> Column:
    """How many splitters lie at or below the key."""
    shard = F.lit(0)
    for start in starts:
        shard = shard + F.when(key >= F.lit(start), 1).otherwise(0)
    return shard.cast("int")


def numbered(rows: DataFrame, shard: str, slot: str, part: str, by: str) -> DataFrame:
    """Rows with a gapless number within their shard: those of one *part* after the other, in order of *by*.

    Parts are numbered apart and put behind each other, so no task sees a shard.
    """
    n, base = free_name(rows, "slot_rows"), free_name(rows, "slot_base")
    counts = rows.groupBy(F.col(shard).alias("of"), F.col(part).alias("at")).agg(F.count("*").alias(n))
    earlier = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("of", "at", F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(base))
    inside = Window.partitionBy(shard, part).orderBy(by)
    rows = rows.withColumn(slot, F.row_number().over(inside) - 1)
    out = rows.join(bases, (rows[shard] == bases["of"]) & (rows[part] == bases["at"]))
    return out.withColumn(slot, (F.col(slot) + F.col(base)).cast("bigint")).drop("of", "at", base)


def _copies(rows: DataFrame) -> DataFrame:
    """Rows repeated `n` times, numbered by *copy* from 0; many copies of one row are put out by many tasks."""
    starts = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))))
    if rows.filter(F.col("n") > COPIES).take(1):
        starts = starts.repartition("key", "start")
    last = F.least(F.col("start") + COPIES, F.col("n")) - 1
    return starts.withColumn("copy", F.explode(F.sequence("start", last))).drop("start", "n")


def _salt(copy: Column) -> Column:
    """What ends a key: nothing for the first of equal rows."""
    return F.when(copy > 0, F.md5(copy.cast("string").cast("binary"))).otherwise("")


def assigned(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, shard, slot."""
    key = key_of(F.col("text"), F.col("doc_id"))
    rows = docs.select(
        "doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), key.alias("key")
    ).groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n"))
    rows = written(_copies(written(rows)).withColumn("salt", _salt(F.col("copy"))).withColumn("key", F.concat("key", "salt")))
    starts = splitters(rows.select("key", "size"), shards, tolerance)
    # slots follow the doc_id part of the key, which copies of a text do not share
    order = F.substring("key", TEXT_DIGITS + 1, 64)
    part = F.when(F.col("copy") == 0, F.substring(order, 1, DIGITS)).otherwise(F.concat(F.lit("~"), F.substring("salt", 1, DIGITS)))
    placed = rows.withColumn("shard", shard_of(F.col("key"), starts)).withColumns({"order": order, "part": part})
    return numbered(placed, "shard", "slot", "part", "order").select("doc_id", "size", "text_crc32", "shard", "slot")


def sharded_documents(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents with their columns and a shard, exchanged once to be near their shard's others.

    The rows of a shard are spread over ranges of its keys, so that a shard is many tasks. Names
    that the documents already have get a leading underscore for the new column. Rows that repeat doc_id and text
    may differ in other columns; if so many repeat that their bytes matter, a random end of the key tells them apart, which is
    written with the documents before it is used.
    """
    key, shard = free_name(docs, "shard_key"), free_name(docs, "shard")
    rows = docs.withColumn(key, key_of(F.col("text"), F.col("doc_id")))
    sizes = written(rows.select(F.col(key).alias("key"), size_of(F.col("text")).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    same_key = sizes.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    if same_key.filter((F.col("n") > 1) & (F.col("bytes") > tolerance * total / shards)).take(1):
        rows = written(rows.withColumn(key, F.concat(key, F.md5(F.monotonically_increasing_id().cast("string").cast("binary")))))
        sizes = rows.select(F.col(key).alias("key"), size_of(F.col("text")).alias("size"))
    starts = splitters(sizes, shards, tolerance)
    placed = rows.withColumn(shard, shard_of(F.col(key), starts))
    return placed.repartition(F.col(shard), F.substring(key, TEXT_DIGITS + 1, 2), F.substring(key, 2 * TEXT_DIGITS + 1, 2)).drop(key)
