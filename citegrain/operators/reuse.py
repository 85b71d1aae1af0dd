"""Answer reuse within a time to live.

An answer is stored when a request misses. Requests with the same key up to *ttl* later reuse
it, without prolonging it; the first one after that misses and is stored in turn. So the
stored requests of a key form a chain, each the first request later than ttl after the one
before.

A key may hold a third of all requests, however close together, so no task sees a key. Requests are
put in one order, by key and time, and cut into ranges of about `RANGE_ROWS` rows:

1. Every range says what it does to a chain that enters it: the stored time that a chain leaves
   it with. A range that begins and ends in one key is a step table for that: a chain that may store again
   after time u stores the first request after u, and *leaves* with the last one stored from there. Its
   entries lie in the first ttl of the range, and those that lead to the same end are one.
2. One pass over the ranges in order tells the stored time that every range begins with. It holds one range's step table at
   a time, a row for each entry, and never the requests.
3. Every range then walks its own rows once.

The repeat flag needs of the range before only its last request.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from citegrain.functions.text import strip
from citegrain.plans.workdir import discard, written

# Fixed value: default time to live in seconds.
TTL_SEC = 300

#: Requests that a task takes at once.
RANGE_ROWS = 1_000_000

_NEVER = -(1 << 62)


def reuse_key(provider: Column, prompt_style: Column, top_k: Column, question: Column) -> Column:
    return F.concat_ws("|", provider, prompt_style, top_k.cast("string"), strip(question))


def _key_hash(keys: Sequence[str], salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *keys, *[F.col(k).isNull() for k in keys])


def _in_ranges(requests: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], range_rows: int) -> tuple[DataFrame, int]:
    """h1, h2 (of the key), at, o0, o1, ... (the order) and part, a range of that order, for all requests with a time."""
    names = {f"o{i}": c for i, c in enumerate(order)}
    slim = requests.select(
        _key_hash(keys, 1).alias("h1"), _key_hash(keys, 2).alias("h2"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        *[F.col(c).alias(o) for o, c in names.items()],
    ).filter("at is not null")
    slim = written(slim)
    ranges = slim.repartitionByRange(max(1, math.ceil(slim.count() / range_rows)), "h1", "h2", "at", *names)
    ranges = written(ranges.withColumn("part", F.spark_partition_id()))
    discard(slim)
    return ranges, (ranges.agg(F.max("part")).first()[0] or 0) + 1


def _by_range(ranges: DataFrame, parts: int, range_rows: int) -> DataFrame:
    """The ranges in order, several small ones to a task."""
    places = [c for c in ranges.columns if c[0] == "o"]
    tasks = min(parts, max(4 * ranges.sparkSession.sparkContext.defaultParallelism, math.ceil(parts * range_rows / RANGE_ROWS)))
    return ranges.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part", "h1", "h2", "at", *places)


def _each_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one range after the other; a range is bounded by its rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and held[0].column("part")[0] != batch.column("part")[int(a)]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _key_starts(rows: pa.Table) -> np.ndarray:
    """Where a new key begins, the first row included."""
    h1, h2 = (rows[c].to_numpy() for c in ("h1", "h2"))
    return np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])


def step_table(at: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries and the stored times they leave with, for the sorted times of one key."""
    after = np.searchsorted(at, at + ttl, side="right")
    leaves = at.copy()
    for i in range(len(at) - 1, -1, -1):
        if after[i] < len(at):
            leaves[i] = leaves[after[i]]
    n = min(len(at), int(after[0]) + 1)
    entry, leaves = at[:n], leaves[:n]
    keep = np.r_[leaves[1:] != leaves[:-1], True]
    return entry[keep], leaves[keep]


def _last_stored(at: np.ndarray, ttl: int) -> int:
    i = 0
    while (after := int(np.searchsorted(at, at[i] + ttl, side="right"))) < len(at):
        i = after
    return int(at[i])


_RANGE = "part int, first1 bigint, first2 bigint, last1 bigint, last2 bigint, whole boolean, entry bigint, leaves bigint, last_at bigint"


def _summaries(ttl: int, repeats: bool):
    """Each range's first and last key and what it does to a chain of the first: a row for each entry, or one row."""
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "boolean": pa.bool_()}.get(c.split()[1], pa.int64())) for c in _RANGE.split(", ")])

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_range(batches):
            at, starts = rows["at"].to_numpy(), _key_starts(rows)
            ends = [rows[c][i].as_py() for i in (0, len(at) - 1) for c in ("h1", "h2")]
            whole = len(starts) == 1
            if repeats:  # the last request is all that counts
                entry, leaves = [None], [None]
            elif whole:
                entry, leaves = step_table(at, ttl)
            else:
                entry, leaves = [None], [_last_stored(at[starts[-1] :], ttl)]
            n = len(entry)
            values = [[rows["part"][0].as_py()] * n, *[[e] * n for e in ends], [whole] * n, entry, leaves, [int(at[-1])] * n]
            table = pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)
            yield from table.to_batches(max_chunksize=10_000)

    return summarize


def _entered(ttl: int):
    """What every range begins with, from the ranges in order: until when an answer lasts, and the request before."""
    types = [pa.int32(), pa.int64(), pa.int64()]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "until", "before"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stored, before, found = None, _NEVER, None, []
        for rows in _each_range(batches):
            first, last = ((rows[f"{c}1"][0].as_py(), rows[f"{c}2"][0].as_py()) for c in ("first", "last"))
            same = key == first
            until = stored + ttl if same else _NEVER
            found.append((rows["part"][0].as_py(), until, before if same else None))
            at = 0
            if same and rows["whole"][0].as_py() and rows["entry"].null_count == 0:
                at = int(np.searchsorted(rows["entry"].to_numpy(), until, side="right"))
            if at < rows.num_rows and rows["leaves"][at].is_valid:
                stored = rows["leaves"][at].as_py()
            key, before = last, rows["last_at"][0].as_py()
            if len(found) == 1000:
                yield batch_of(found)
                found = []
        yield batch_of(found)

    return enter


def _unflagged(ttl: int, repeats: bool, places: list[str]):
    """The requests that no earlier one answers: the stored ones, or those without a recent request before."""
    names = ["h1", "h2", *places]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_range(batches):
            at, starts = rows["at"].to_numpy(), _key_starts(rows)
            until, before = rows["until"][0].as_py(), rows["before"][0].as_py()
            if repeats:
                gap = np.r_[_NEVER if before is None else before, at[:-1]]
                gap[starts[1:]] = _NEVER
                picked = np.flatnonzero(at > gap + ttl)
            else:
                fresh, picked = set(starts[1:].tolist()), []
                for i, t in enumerate(at.tolist()):
                    if i in fresh:
                        until = _NEVER
                    if t > until:
                        picked.append(i)
                        until = t + ttl
            out = rows.select(names).take(pa.array(picked, pa.int64())).combine_chunks()
            yield from out.to_batches()

    return walk


def _flagged(
    requests: DataFrame, keys: Sequence[str], ts: str, order: str | Sequence[str], ttl_sec: int, name: str, repeats: bool, range_rows: int
) -> DataFrame:
    order, ttl = [order] if isinstance(order, str) else list(order), ttl_sec * 1_000_000
    ranges, parts = _in_ranges(requests, keys, ts, order, range_rows)
    # written by many tasks; a coalesce would pull them, and all requests, into the one that follows
    summaries = written(_by_range(ranges, parts, range_rows).select("part", "h1", "h2", "at").mapInArrow(_summaries(ttl, repeats), _RANGE))
    # in one task, a range at a time: what a chain has stored passes from range to range
    one = summaries.coalesce(1).sortWithinPartitions("part", "entry")
    entered = written(one.mapInArrow(_entered(ttl), "part int, until bigint, before bigint"))
    discard(summaries)
    rows = _by_range(ranges.join(F.broadcast(entered), "part"), parts, range_rows)
    places = [c for c in ranges.columns if c[0] == "o"]
    kinds = {f.name: f for f in ranges.schema.fields}
    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("h1", "h2", *places))
    to_arrow_schema(ranges.schema)  # raises here, and not in a task, if a type cannot travel
    marked = rows.mapInArrow(_unflagged(ttl, repeats, places), schema)
    marked = marked.select(*[F.col(c).alias(f"_m_{c}") for c in marked.columns])
    on = (_key_hash(keys, 1) == F.col("_m_h1")) & (_key_hash(keys, 2) == F.col("_m_h2"))
    for o, c in zip(places, order):
        on = on & F.col(c).eqNullSafe(F.col(f"_m_{o}"))
    met = requests.join(marked, on, "left")
    flag = F.col("_m_h1").isNull() & F.col(ts).cast("timestamp").isNotNull()
    return met.withColumn(name, flag).drop(*marked.columns)


def mark_repeats(
    requests: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    order: str | Sequence[str] = "event_id",
    ttl_sec: int = TTL_SEC,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Adds ``repeated``: another request with the key came at most *ttl_sec* earlier.

    Requests at the same time follow *order*, a column or columns that tell all requests apart. Requests without
    a time are no repeats.
    """
    return _flagged(requests, keys, ts, order, ttl_sec, "repeated", True, range_rows)


def mark_reuse(
    requests: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    order: str | Sequence[str] = "event_id",
    ttl_sec: int = TTL_SEC,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Adds ``reused``: the request is answered by one stored at most *ttl_sec* earlier.

    Requests at the same time follow *order*, a column or columns that tell all requests apart. Exact for any
    number of rows per key and ttl. Requests without a time reuse nothing.
    """
    return _flagged(requests, keys, ts, order, max(1, ttl_sec), "reused", False, range_rows)
