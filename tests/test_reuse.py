import datetime as dt

import numpy as np
import pytest

from citegrain.operators import reuse

EPOCH = dt.datetime(2026, 2, 16)
SCHEMA = "key string, ts timestamp, event_id long"


def by_hand(rows, ttl):
    """Sequential rule per key: a miss stores, a request up to ttl later reuses."""
    stored, reused, last, repeated = {}, {}, {}, {}
    for key, ts, number in sorted(rows, key=lambda r: (r[1], r[2])):
        reused[number] = key in stored and ts <= stored[key] + ttl
        if not reused[number]:
            stored[key] = ts
        repeated[number] = key in last and ts <= last[key] + ttl
        last[key] = ts
    return reused, repeated


def requests(seed, n, keys, span_sec):
    """Requests a third of which share one key; whole seconds, so equal times occur."""
    rng = np.random.default_rng(seed)
    return [
        (
            "hot" if i % 3 == 0 else f"k{rng.integers(keys)}",
            EPOCH + dt.timedelta(seconds=int(rng.integers(span_sec))),
            i,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("how", [{}, {"range_rows": 60}, {"range_rows": 7}])
@pytest.mark.parametrize("seed, n, keys, span", [(1, 400, 5, 3000), (2, 600, 40, 20000), (3, 300, 2, 400)])
def test_equals_the_sequential_rule(spark, how, seed, n, keys, span):
    rows = requests(seed, n, keys, span)
    want, _ = by_hand(rows, dt.timedelta(seconds=60))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = reuse.mark_reuse(df, ["key"], ttl_sec=60, **how).collect()
    assert {r.event_id: r.reused for r in got} == want
    assert len(got) == n and got[0].__fields__ == ["key", "ts", "event_id", "reused"]


def test_repeats_and_bound(spark):
    rows = requests(5, 500, 10, 5000)
    want, repeated = by_hand(rows, dt.timedelta(seconds=45))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.event_id: r.repeated for r in reuse.mark_repeats(df, ["key"], ttl_sec=45).collect()}
    assert got == repeated
    assert all(got[i] for i, hit in want.items() if hit)


def test_one_dense_key_is_cut_by_rows(spark):
    """All rows under one key, within one ttl of a day: no range is larger than a few times its rows."""
    rows = [("k", EPOCH + dt.timedelta(seconds=i * 3 % 86_000), i) for i in range(600)] + [("k", EPOCH, 1000 + i) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    want, repeated = by_hand(rows, dt.timedelta(days=1))
    got = {r.event_id: r.reused for r in reuse.mark_reuse(df, ["key"], ttl_sec=86_400, range_rows=50).collect()}
    assert got == want
    got = {r.event_id: r.repeated for r in reuse.mark_repeats(df, ["key"], ttl_sec=86_400, range_rows=50).collect()}
    assert got == repeated
    ranges, parts = reuse._in_ranges(df, ["key"], "ts", ["event_id"], 50)
    largest = ranges.groupBy("part").count().agg({"count": "max"}).first()[0]
    assert parts >= 10 and largest <= 150


def test_step_tables_pass_a_chain_as_its_rows_do():
    rng = np.random.default_rng(3)
    for _ in range(200):
        at, ttl = np.sort(rng.integers(0, 200, rng.integers(1, 40))), int(rng.integers(1, 60))
        entry, leaves = reuse.step_table(at, ttl)
        until = int(rng.integers(-10, at[0] + ttl + 1))
        stored, left = [], until
        for t in at.tolist():
            if t > left:
                stored.append(t)
                left = t + ttl
        i = int(np.searchsorted(entry, until, side="right"))
        assert (leaves[i] if i < len(entry) else None) == (stored[-1] if stored else None)


def test_null_keys_are_keys(spark):
    rows = [(None, EPOCH, 1), (None, EPOCH + dt.timedelta(seconds=5), 2), ("", EPOCH, 3)]
    got = {r.event_id: r.reused for r in reuse.mark_reuse(spark.createDataFrame(rows, SCHEMA), ["key"]).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_edge_of_the_ttl(spark):
    at = [0, 300, 301, 601, 602]
    rows = [("k", EPOCH + dt.timedelta(seconds=s), s) for s in at] + [("k", None, 999)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.event_id: r.reused for r in reuse.mark_reuse(df, ["key"]).collect()}
    assert got == {0: False, 300: True, 301: False, 601: True, 602: False, 999: False}


def test_key_text(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(reuse.reuse_key(F.lit("echo"), F.lit("v1"), F.lit(3), F.lit(" why\n")))
    assert row.first()[0] == "echo|v1|3|why"


def test_the_pass_over_the_ranges_holds_one_range_at_a_time(spark):
    """Step tables come as rows, cut into batches anywhere, and the requests themselves are not among them."""
    import pyarrow as pa

    ttl, rng = 50, np.random.default_rng(3)
    at = np.sort(rng.integers(0, 2000, 400))
    starts = [0, 150, 151, 260, 400]
    ranges = [pa.table({"part": pa.array([i] * (b - a), pa.int32()), "h1": [1] * (b - a), "h2": [2] * (b - a), "at": at[a:b]}) for i, (a, b) in enumerate(zip(starts, starts[1:]))]
    summaries = pa.Table.from_batches(reuse._summaries(ttl, False)(iter(pa.concat_tables(ranges).to_batches())))
    assert all(summaries.schema.field(c).type == pa.int64() for c in ("entry", "leaves"))
    entered = pa.Table.from_batches(reuse._entered(ttl)(iter(summaries.to_batches(max_chunksize=3)))).to_pydict()
    stored, want = None, []
    for a, b in zip(starts, starts[1:]):
        want.append(reuse._NEVER if stored is None else stored + ttl)
        for t in at[a:b].tolist():
            if stored is None or t > stored + ttl:
                stored = t
    assert entered["until"] == want and entered["before"] == [None, *(int(at[b - 1]) for b in starts[1:-1])]


def test_no_task_sorts_all_ranges(spark):
    """The job that hands chains on reads written summaries, so it has no request to sort."""
    rows = requests(6, 300, 3, 3000)
    seen = []
    plain = reuse.written

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    reuse.written = noted
    try:
        reuse.mark_reuse(spark.createDataFrame(rows, SCHEMA), ["key"], ttl_sec=60, range_rows=20)
    finally:
        reuse.written = plain
    one = [p for p in seen if "Coalesce" in p]
    assert len(one) == 1 and one[0].count("MapInArrow") == 1
