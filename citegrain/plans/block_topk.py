"""Exact top-k of every question over a large table of items, without emitting pairs.

All scores of a question are looked at, but only inside a task and only a block at a time:
a task keeps the k best items per question and emits those, and a window merges them.

* Few questions (at most *max_broadcast* rows holding at most MAX_BROADCAST_VALUES numbers, both
  counted first) are broadcast, and the items are read where they lie.
* More questions meet the items in a grid of cells: questions are dealt to groups, items to parts, and one job
  sends every group and every part to their cells. A task takes a cell: it holds the group and lets the part pass by.
  Nothing goes through the driver. Questions travel once for each part and items once for each group; both counts
  are bounded below by what a task may hold, and above them are chosen for the least shuffle.

What a score is, is up to a scorer: ``scorer(questions: pa.Table)`` returns a function
``best(items: pa.Table, k, floor) -> (question_rows, item_rows, scores)``, an iterator of parts of the answer that
together give each question's k best rows among those not below ``floor[question]``. Items
arrive sorted by the tie-break columns, NULL first, so among equal scores the first rows win. Rows whose
array is NULL have no score on either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.plans.workdir import written

Scorer = Callable[[pa.Table], Callable]

MAX_BROADCAST_QUESTIONS = 4096
# numbers or tokens in a broadcast, or in a group of questions that a task holds
MAX_BROADCAST_VALUES = 8_000_000
# hits that a task holds, and hits in a broadcast
MAX_HELD_HITS = 500_000
# numbers in the items of a cell, and scores that are worth a cell of their own
MAX_CELL_VALUES = 32_000_000
MIN_CELL_SCORES = 1 << 28
# items looked at with one floor: at first few, then twice as many each time
FIRST_CHUNK, LAST_CHUNK = 1024, 32_768


def _merge_best(
    question: np.ndarray, score: np.ndarray, rows: pa.Table, ties: Sequence[str], k: int
) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """The k best candidates of each question: score falling, then the tie columns rising, NULL first."""
    order = np.lexsort((-score, question))
    q, s = question[order], score[order]
    like_last = np.r_[False, (q[1:] == q[:-1]) & (s[1:] == s[:-1])]
    tied = like_last | np.r_[like_last[1:], False]
    if tied.any():
        # equal scores of a question lie side by side, so ordering them among themselves leaves the others in place
        some = order[tied]
        place = pa.table({"run": np.cumsum(~like_last)[tied], **{t: rows[t].take(pa.array(some)) for t in ties}})
        keys = [("run", "ascending"), *[(t, "ascending") for t in ties]]
        order[tied] = some[pc.sort_indices(place, sort_keys=keys, null_placement="at_start").to_numpy()]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    order = order[rank < k]
    return question[order], score[order], rows.take(pa.array(order))


def _in_chunks(batches: Iterator[pa.RecordBatch | pa.Table]) -> Iterator[pa.Table]:
    """The rows again, in chunks that grow from `FIRST_CHUNK` to `LAST_CHUNK` rows."""
    held: list[pa.Table] = []
    n, size = 0, FIRST_CHUNK
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        at = 0
        while at < rows.num_rows:
            held.append(rows.slice(at, size - n))
            n, at = n + held[-1].num_rows, at + held[-1].num_rows
            if n == size:
                yield pa.concat_tables(held).combine_chunks()
                held, n, size = [], 0, min(2 * size, LAST_CHUNK)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _task_best(
    questions: pa.Table,
    batches: Iterator[pa.RecordBatch | pa.Table],
    scorer: Scorer,
    k: int,
    key: str,
    ties: Sequence[str],
    payload: Sequence[str],
) -> pa.Table | None:
    n = questions.num_rows
    if n == 0:
        return None
    best = scorer(questions)
    floor = np.full(n, -np.inf)
    kept: tuple[np.ndarray, np.ndarray, pa.Table] | None = None
    for part in _in_chunks(batches):
        part = part.take(pc.sort_indices(part, sort_keys=[(t, "ascending") for t in ties], null_placement="at_start"))
        part = part.combine_chunks()
        for q, rows, s in best(part, k, floor):
            if len(q) == 0:
                continue
            found = part.select(payload).take(pa.array(rows))
            if kept is not None:
                q, s = np.r_[kept[0], q], np.r_[kept[1], s]
                found = pa.concat_tables([kept[2], found])
            kept = _merge_best(q, s, found, ties, k)
        if kept is not None:
            full = np.bincount(kept[0], minlength=n) >= k
            lowest = np.full(n, np.inf)
            np.minimum.at(lowest, kept[0], kept[1])
            floor = np.where(full, lowest, -np.inf)
    if kept is None:
        return None
    q, s, found = kept
    found = found.add_column(0, key, questions[key].combine_chunks().take(pa.array(q)))
    return found.append_column("score", pa.array(s, pa.float64()))


def _measured(df: DataFrame, array: str) -> tuple[int, int]:
    """Rows, and the values their *array* column holds."""
    row = df.agg(F.count("*").alias("rows"), F.sum(F.size(array)).alias("held")).first()
    return row["rows"], row["held"] or 0


def blocked_top_k(
    questions: DataFrame,
    items: DataFrame,
    k: int,
    scorer: Scorer,
    key: str,
    ties: Sequence[str],
    values: str,
    carry: Sequence[str] = (),
    attach: Sequence[str] = (),
    max_broadcast: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """Rows ``key, rank, *ties, score, *carry, *attach``. Runs jobs on the questions when called.

    *values* names the array column of both sides that the scorer reads, and *ties* the item
    columns that tell equal scores, and items, apart. Columns in *carry* travel through the
    tasks with the items, so they must be short; those in *attach*, such as whole texts, stay
    in the JVM and are joined to the hits at the end. Items that share all tie columns are one
    item to *attach*: their hits show the smallest of its values.
    """
    # written once, so that vectors that a model makes are made once
    asked = _with_values(written(questions.select(key, values)), values)
    rows, held = _measured(asked, values)
    payload = [*ties, *[c for c in carry if c not in ties]]
    in_place = rows <= max_broadcast and held <= MAX_BROADCAST_VALUES
    if in_place:
        partial = _of_broadcast(asked, items, k, scorer, key, ties, values, payload)
    else:
        partial = _of_grid(asked, rows, held, items, k, scorer, key, ties, values, payload)
    order = Window.partitionBy(key).orderBy(F.desc("score"), *ties)
    hits = (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(key, "rank", *ties, "score", *[c for c in payload if c not in ties])
    )
    if not in_place:
        hits = written(hits)  # the grid is searched once, however often the hits are read
    if not attach:
        return hits
    return with_attached(hits, items, ties, attach, rows * k <= MAX_HELD_HITS)


def _with_values(table: DataFrame, values: str) -> DataFrame:
    """The rows that have an array; asked of a written table, as a filter in front would make every array twice."""
    return table.filter(F.col(values).isNotNull())


def _partial_schema(questions: DataFrame, items: DataFrame, key: str, payload: Sequence[str]) -> T.StructType:
    fields = [questions.schema[key], *[items.schema[c] for c in payload]]
    return T.StructType([*fields, T.StructField("score", T.DoubleType())])


def _of_broadcast(
    questions: DataFrame, items: DataFrame, k: int, scorer: Scorer, key: str, ties: Sequence[str], values: str, payload: list[str]
) -> DataFrame:
    """The k best of every task for questions that fit a broadcast."""
    inputs = list(dict.fromkeys([*payload, values]))
    shared = questions.sparkSession.sparkContext.broadcast(questions.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _task_best(shared.value, batches, scorer, k, key, ties, payload)
        if found is not None:
            yield from found.to_batches()

    return items.filter(F.col(values).isNotNull()).select(*inputs).mapInArrow(scan, _partial_schema(questions, items, key, payload))


def _grid(rows: int, held: int, n_items: int, item_values: int, k: int, tasks: int) -> tuple[int, int]:
    """Groups of questions and parts of items: no cell beyond what a task may hold, enough cells for all tasks where
    that pays, and as little shuffled as that allows."""
    least_groups = max(1, -(-held // MAX_BROADCAST_VALUES), -(-rows * k // MAX_HELD_HITS))
    least_parts = max(1, -(-item_values // MAX_CELL_VALUES))
    cells = max(least_groups * least_parts, min(tasks, -(-rows * n_items // MIN_CELL_SCORES)))
    # an item travels to each group, a question to each part, and from there k hits of about 16 numbers' size come back
    question_cost, item_cost = held + 16 * k * rows, max(1, item_values)
    groups = max(least_groups, min(round((cells * question_cost / item_cost) ** 0.5), -(-cells // least_parts)))
    return groups, max(least_parts, -(-cells // groups))


def _of_grid(
    asked: DataFrame, rows: int, held: int, items: DataFrame, k: int, scorer: Scorer, key: str, ties: Sequence[str], values: str, payload: list[str]
) -> DataFrame:
    """The k best of every cell for any number of questions."""
    spark = asked.sparkSession
    slim = _with_values(written(items.select(*dict.fromkeys([*payload, values]))), values)
    n_items, item_values = _measured(slim, values)
    groups, parts = _grid(rows, held, n_items, item_values, k, 4 * spark.sparkContext.defaultParallelism)

    def dealt(n: int):
        # rows in the order of the written files, so no key and no copy decides; the hash spreads runs of rows
        return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")

    # both sides as rows of one table: the questions of a cell come first; doubles hold the numbers of either side exactly
    kind = asked.schema[values].dataType if asked.schema[values].dataType == slim.schema[values].dataType else T.ArrayType(T.DoubleType())
    names = [f"i{i}" for i in range(len(payload))]
    left = asked.select(F.col(key).alias("q"), F.col(values).cast(kind).alias("v"), dealt(groups).alias("g")).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.col("g") * parts + p)).alias("cell"), F.lit(0).alias("side"), "q",
        *[F.lit(None).cast(slim.schema[c].dataType).alias(n) for c, n in zip(payload, names)], "v",
    )
    right = slim.select(*[F.col(c).alias(n) for c, n in zip(payload, names)], F.col(values).cast(kind).alias("v"), dealt(parts).alias("p")).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * parts + F.col("p"))).alias("cell"), F.lit(1).alias("side"),
        F.lit(None).cast(asked.schema[key].dataType).alias("q"), *names, "v",
    )
    cells = left.unionByName(right).repartitionById(groups * parts, "cell").sortWithinPartitions("cell", "side")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for questions, items_of_cell in _each_cell(batches):
            questions = questions.select(["q", "v"]).rename_columns([key, values])
            named = (x.select([*names, "v"]).rename_columns([*payload, values]) for x in items_of_cell)
            found = _task_best(questions, named, scorer, k, key, ties, payload)
            if found is not None:
                yield from found.to_batches()

    return cells.mapInArrow(scan, _partial_schema(asked, slim, key, payload))


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Iterator[pa.Table]]]:
    """Each cell's questions, and its items as they come; rows are sorted by cell and side."""

    def runs() -> Iterator[tuple[int, int, pa.Table]]:
        for batch in batches:
            cell, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(cell)].tolist()):
                if a < b:
                    yield int(cell[a]), int(side[a]), pa.Table.from_batches([batch.slice(a, b - a)])

    source = runs()
    ahead = next(source, None)

    def of(cell: int, side: int) -> Iterator[pa.Table]:
        nonlocal ahead
        while ahead is not None and ahead[:2] == (cell, side):
            yield ahead[2]
            ahead = next(source, None)

    while ahead is not None:
        cell = ahead[0]
        questions = [*of(cell, 0)]
        items = of(cell, 1)
        if questions:
            yield pa.concat_tables(questions).combine_chunks(), items
        for _ in items:  # what nobody asked for
            pass


def with_attached(hits: DataFrame, items: DataFrame, ties: Sequence[str], attach: Sequence[str], few: bool) -> DataFrame:
    """The hits with the columns *attach* of their items, each taken from the items once."""
    named = hits.select(*[F.col(c).alias(f"hit_{c}") if c in ties else F.col(c) for c in hits.columns])
    of_hits = [c for c in named.columns if not c.startswith("hit_")]
    texts = items.select(*ties, *[F.col(c).alias(f"attach_{c}") for c in attach])
    smallest = F.min(F.struct(*[f"attach_{c}" for c in attach])).alias("texts")
    same = reduce(and_, [F.col(f"hit_{t}").eqNullSafe(F.col(t)) for t in ties])
    if few:
        met = texts.join(F.broadcast(named), same).groupBy(*of_hits, *ties).agg(smallest)
    else:
        wanted = hits.select(*[F.col(t).alias(f"hit_{t}") for t in ties]).distinct()
        met = named.join(texts.join(wanted, same, "left_semi").groupBy(*ties).agg(smallest), same)
    return met.select(*hits.columns, *[F.col(f"texts.attach_{c}").alias(c) for c in attach])
