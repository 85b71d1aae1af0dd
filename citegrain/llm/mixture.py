"""Mixing sources to target weights by weighted fair queueing.

The documents of a source wait in a fixed random order (the MD5 of seed and doc_id), up to
`repeats` times over. Each waiting copy gets a virtual finish time: the words of its source up
to and with it, divided by the source's target. The mix is the copies in order of that time, cut
off where the next one would pass the total budget, so every source stays within about one
document of its target.

Targets share the budget by weight; a target above `repeats` times its source's words stops
there and the rest is shared again among the others, by weight, until none is above. Sources
are weighted 1, 2, 3, repeating, in order of their code points, null last.

A text's size is its words between ASCII white space; null and empty texts have size 0, take
nothing and never stop the cut. Rows that repeat a document (doc_id, source and text) queue as
one entry and are taken alike. A null doc_id orders as the empty text. An empty table gives an
empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.common import free_name, same, word_count
from citegrain.plans.workdir import written

WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Digits of the random order that split a source into ranges summed apart: 16 ** 3 of them.
RANGE_DIGITS = 3
#: Virtual time is searched in steps, refined until one holds at most this many copies.
LAST_STEP_ROWS = 100_000
STEPS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, source_size, rank, weight, target.

    Sources meet in one task here, one row each; their documents were summed before.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(repeats))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    below = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    # the level that shares what the sources with smaller ratios leave over, if they stop at their caps
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    levels = caps.withColumn("level", left / shares)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select(
        "source", "source_size", "rank", "weight", "target"
    )


def queued(docs: DataFrame, seed: int = 0, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Each distinct document with its place in its source's queue: doc_id, source, text_key,
    n_rows, size, source_size, rank, target, before (words of the source up to and with it)."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select("doc_id", "source", _text_key(F.col("text")).alias("text_key"), word_count(F.col("text")).alias("size"))
    rows = written(sized.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("n_rows")).withColumn("place", place))
    rows = rows.withColumn("words", F.col("size") * F.col("n_rows"))
    targets = source_targets(rows.select("source", F.col("words").alias("size")), weights, repeats)
    # Ranges of the random order hold about equally many documents of a source, however large it is.
    rows = rows.withColumn("range", F.substring("place", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", "range").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(targets, same(starts["source"], targets["source"])).select(
        starts["source"].alias("of"), F.col("range").alias("at"), "start", "source_size", "rank", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("words").over(inside))
    return rows.join(starts, same(rows["source"], starts["of"]) & (rows["range"] == starts["at"])).select(
        "doc_id", "source", "text_key", "n_rows", "size", "source_size", "rank", "target",
        (F.col("start") + F.col("inside")).alias("before"),
    )


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def finish_time(copy: Column) -> Column:
    return (F.col("before") + copy * F.col("source_size")) / F.col("target")


@dataclass(frozen=True)
class Cut:
    """The last copy that the mix takes."""

    finish: float
    rank: int
    before: int

    def takes(self, copy: Column) -> Column:
        f = finish_time(copy)
        within = F.struct("rank", "before") <= F.struct(F.lit(self.rank).cast("int"), F.lit(self.before).cast("bigint"))
        return (f < self.finish) | ((f == self.finish) & within)


def cut_of(queue: DataFrame, repeats: int = REPEATS) -> Cut | None:
    """Where the copies in order of finish time reach the budget, all words of all documents.

    A histogram over virtual time finds the step in which that happens and is refined there;
    only that step's copies are put in order. None: the mix takes nothing.
    """
    order = ("finish", "rank", "before")
    queue = queue.select("rank", "before", "source_size", "target", (F.col("size") * F.col("n_rows")).alias("words"))
    budget = queue.agg(F.sum("words")).first()[0] or 0
    copies = queue.filter(F.col("words") > 0).withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    inside = copies.select("words", "rank", "before", finish_time(F.col("copy")).alias("finish"))
    earlier, taken, low, width = None, 0, 0.0, 8.0 / STEPS
    while True:
        step = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(STEPS))
        bins = inside.groupBy(step.alias("step")).agg(F.sum("words").alias("words"), F.count("*").alias("n")).orderBy("step").collect()
        crossing = None
        for b in bins:  # at most STEPS + 1
            if taken + b["words"] > budget:
                crossing = b
                break
            taken += b["words"]
        if crossing is None:
            earlier = inside
            break
        if crossing["step"] > bins[0]["step"]:
            earlier = inside.filter(step < crossing["step"])
        inside = inside.filter(step == crossing["step"])
        start, finer = low + crossing["step"] * width, width / STEPS
        if crossing["n"] <= LAST_STEP_ROWS or crossing["step"] == STEPS or start + finer == start:
            running = F.sum("words").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            within = inside.withColumn("running", running).filter(F.col("running") <= F.lit(budget - taken))
            earlier = within if within.first() else earlier
            break
        low, width = start, finer
    last = earlier.orderBy(*[F.desc(c) for c in order]).first() if earlier is not None else None
    return Cut(last["finish"], last["rank"], last["before"]) if last else None


def _taken(docs: DataFrame, seed: int, weights, repeats: int) -> DataFrame:
    queue = written(queued(docs, seed, weights, repeats))
    cut, copies = cut_of(queue, repeats), F.lit(0)
    if cut is not None:
        for i in range(repeats):
            copies = copies + F.when((F.col("size") > 0) & cut.takes(F.lit(i)), 1).otherwise(0)
    return queue.withColumn("copies", copies.cast("int"))


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, taken, copies, virtual_finish."""
    finish = F.when(F.col("size") > 0, finish_time(F.lit(0)))
    rows = _taken(docs, seed, weights, repeats).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
        "copies", finish.alias("virtual_finish"),
    )


def mixed_documents(docs: DataFrame, seed: int = 0, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns."""
    key, source, text, copies, now = (free_name(docs, x) for x in ("mix_id", "mix_source", "mix_text", "mix_copies", "text_key"))
    taken = _taken(docs, seed, weights, repeats).filter("copies > 0").select(
        F.col("doc_id").alias(key), F.col("source").alias(source), F.col("text_key").alias(text), F.col("copies").alias(copies)
    )
    rows = docs.withColumn(now, _text_key(F.col("text")))
    on = same(rows["doc_id"], taken[key]) & same(rows["source"], taken[source]) & (rows[now] == taken[text])
    # the small rows are hashed, so texts are shuffled once and never sorted
    joined = rows.join(taken.hint("shuffle_hash"), on)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
