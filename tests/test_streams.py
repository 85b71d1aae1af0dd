"""Streams over several micro-batches against the batch operators."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.catalog.views import request_log
from citegrain.operators import logs, reuse
from citegrain.sources.request_log import parse_log_lines
from citegrain.streaming import ingest, metrics
from citegrain.streaming.reuse import correct_stream_reuse, mark_stream_reuse

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def batch(spark):
    rows = request_log(spark, SF_DIR).persist()
    yield rows
    rows.unpersist()


@pytest.fixture(scope="module")
def folder(spark, batch, tmp_path_factory):
    """The log as four files in time order, a micro-batch each."""
    path = tmp_path_factory.mktemp("log")
    rows = sorted(batch.collect(), key=lambda r: (r.ts, r.event_id))
    size = -(-len(rows) // 4)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], batch.schema).coalesce(1).write.parquet(f"{path}/{i:06d}")
    return path


def stream(spark, folder, batch):
    return (
        spark.readStream.schema(batch.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(folder))
    )


def finish(query):
    query.awaitTermination()
    return query


def test_totals(spark, batch, folder, tmp_path):
    out = str(tmp_path / "totals")
    totals = metrics.running_totals(stream(spark, folder, batch))
    finish(metrics.write_snapshots(totals, out, str(tmp_path / "c"), True))
    want = metrics.running_totals(batch)
    assert sorted(metrics.latest_snapshot(spark, out).collect()) == sorted(want.collect())
    assert spark.read.parquet(out).select("batch").distinct().count() == 4


def test_closed_windows(spark, batch, folder, tmp_path):
    out = str(tmp_path / "windows")
    counts = metrics.window_counts(stream(spark, folder, batch), "1 day")
    finish(metrics.write_closed_windows(counts, metrics.window_slo, out, str(tmp_path / "c"), True))
    got = spark.read.parquet(out).drop("batch")
    mark = batch.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    whole = metrics.window_slo(metrics.window_counts(batch, "1 day"))
    want = whole.filter(F.col("window_end") <= F.lit(mark))
    key = lambda r: (r.window_start, r.endpoint)
    shown = [*got.columns]
    have, need = sorted(got.collect(), key=key), sorted(want.select(*shown).collect(), key=key)
    assert len(have) > 20 and have == need
    by_endpoint = logs.slo_check(batch.filter(F.to_date("ts") == F.lit(have[0].window_start.date())), ["endpoint"])
    first = {r.endpoint: r for r in by_endpoint.collect()}
    assert first[have[0].endpoint].p95_ms == pytest.approx(have[0].p95_ms)


def test_reuse(spark, batch, folder, tmp_path):
    day = 86400
    asked = logs.only_endpoint(stream(spark, folder, batch)).withColumn("key", F.col("provider"))
    query = (
        mark_stream_reuse(asked, ttl_sec=day)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    finish(query)
    got = {r.event_id: r.reused for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = reuse.mark_reuse(logs.only_endpoint(batch), ["provider"], ttl_sec=day)
    assert got == {r.event_id: r.reused for r in whole.collect()}
    assert 0 < sum(got.values()) < len(got)


def test_late_rows_are_judged(spark, tmp_path):
    """A file hours late: all rows come out, and those from before the stored answer are no reuse."""
    start = dt.datetime(2026, 2, 16, 12)
    sent = [[(0, 0), (1, 100)], [(2, 20_000)], [(3, 50), (4, 20_100)], [(5, 20_200)]]
    source = tmp_path / "in"
    for i, rows in enumerate(sent):
        data = [("k", start + dt.timedelta(seconds=sec), n) for n, sec in rows]
        spark.createDataFrame(data, "key string, ts timestamp, event_id long").coalesce(1).write.parquet(f"{source}/{i}")
    asked = (
        spark.readStream.schema("key string, ts timestamp, event_id long")
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(source))
    )
    query = (
        mark_stream_reuse(asked, ttl_sec=300)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    finish(query)
    got = {r.event_id: r.reused for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: True, 5: True}


def parts(spark, folder, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def run_to_files(rows, tmp_path):
    finish(
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    return str(tmp_path / "out")


def test_late_rows_correct_what_came_before_them(spark, tmp_path):
    """The last revision of every row is what the batch says; a row beyond the allowed delay corrects none."""
    start, rng = dt.datetime(2026, 2, 16), np.random.default_rng(4)
    rows = [(f"k{i % 3}", start + dt.timedelta(seconds=int(rng.integers(3000))), i) for i in range(300)] + [("k0", None, 999)]
    order = rng.permutation(len(rows))
    sent = [[rows[j] for j in order[a : a + 76]] for a in range(0, len(rows), 76)]
    schema = "key string, ts timestamp, event_id long"
    out = run_to_files(correct_stream_reuse(parts(spark, tmp_path / "in", schema, *sent), ttl_sec=60, delay_sec=5000), tmp_path)
    got = spark.read.parquet(out)
    last = {r.event_id: r.reused for r in got.groupBy("event_id").agg(F.max_by("reused", "revision").alias("reused")).collect()}
    want = reuse.mark_reuse(spark.createDataFrame(rows, schema), ["key"], ttl_sec=60)
    assert last == {r.event_id: r.reused for r in want.collect()}
    assert got.filter("revision > 0").count() > 0
    assert got.groupBy("event_id", "revision").count().filter("count > 1").count() == 0


def test_corrections_end_with_the_delay(spark, tmp_path):
    start = dt.datetime(2026, 2, 16)
    at = lambda n, sec: ("k", start + dt.timedelta(seconds=sec), n)
    stream_ = parts(spark, tmp_path / "in", "key string, ts timestamp, event_id long", [at(0, 100), at(1, 130)], [at(2, 80)], [at(3, 9000)], [at(4, 90), at(5, 9010)])
    out = run_to_files(correct_stream_reuse(stream_, ttl_sec=60, delay_sec=600), tmp_path)
    got = sorted((r.event_id, r.revision, r.reused) for r in spark.read.parquet(out).collect())
    # 2 is stored in the place of 0 and answers both; 4 is too late to correct anything
    assert [g for g in got if g[0] != 4] == [(0, 0, False), (0, 1, True), (1, 0, True), (2, 0, False), (3, 0, False), (5, 0, True)]
    assert [g[:2] for g in got if g[0] == 4] == [(4, 0)]


def test_rows_without_a_time_and_a_late_file(spark, batch, tmp_path):
    """Totals count them; windows leave out what has no time or comes behind the allowed delay, and only that."""
    rows = sorted(batch.collect(), key=lambda r: (r.ts, r.event_id))
    untimed = [type(r)(**{**r.asDict(), "ts": None}) for r in rows[::10]]
    rest = [r for i, r in enumerate(rows) if i % 10]
    late, rest = rest[5:25:2], rest[:5] + rest[5:25][1::2] + rest[25:]
    half = len(rest) // 2
    source = parts(spark, tmp_path / "in", batch.schema, untimed + rest[:half], rest[half:], late)
    finish(metrics.write_snapshots(metrics.running_totals(source), str(tmp_path / "totals"), str(tmp_path / "c1"), True))
    assert sorted(metrics.latest_snapshot(spark, str(tmp_path / "totals")).collect()) == sorted(metrics.running_totals(batch).collect())
    finish(metrics.write_closed_windows(metrics.window_counts(source, "1 day"), metrics.window_metrics, str(tmp_path / "w"), str(tmp_path / "c2"), True))
    got = spark.read.parquet(str(tmp_path / "w"))
    timely = spark.createDataFrame(rest, batch.schema)
    mark = timely.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = metrics.window_metrics(metrics.window_counts(timely, "1 day")).filter(F.col("window_end") <= F.lit(mark))
    assert got.agg(F.sum("requests")).first()[0] == want.agg(F.sum("requests")).first()[0]


def test_live_tops_and_last_latencies(spark, batch, folder, tmp_path):
    source = stream(spark, folder, batch)
    finish(metrics.write_changes(metrics.value_counts(source), str(tmp_path / "n"), str(tmp_path / "c1"), True))
    for kind, top in (("query", logs.top_queries), ("prompt_style", logs.top_prompt_styles), ("doc_name", logs.top_source_docs)):
        assert metrics.top_values(spark, str(tmp_path / "n"), kind).collect() == top(batch).collect()
    finish(metrics.write_recent(source, str(tmp_path / "r"), str(tmp_path / "c2"), last_n=70, available_now=True))
    kept = metrics.latest_snapshot(spark, str(tmp_path / "r"))
    assert kept.count() == 70
    assert logs.recent_latency_stats(kept, ["ts", "event_id"], 70).collect() == logs.recent_latency_stats(batch, ["ts", "event_id"], 70).collect()


def test_merged_panes_are_near_the_exact_percentiles(spark, batch):
    """Sliding windows equal merged panes; ranks are off by no more than the sketch says."""
    panes = metrics.pane_sketches(batch, "6 hours")
    for window, slide in (("1 day", "6 hours"), ("1 day", None)):
        windows = metrics.merged_panes(panes, window, slide).collect()
        exact = metrics.window_metrics(metrics.window_counts(batch, window, slide)).collect()
        of = {(r.window_start, r.endpoint): r for r in exact}
        assert {(r.window_start, r.endpoint) for r in windows} == set(of) and len(of) > 20
        for r in windows:
            e = of[r.window_start, r.endpoint]
            assert (r.requests, r.errors) == (e.requests, e.errors) and r.avg_ms == pytest.approx(e.avg_ms)
            mine = sorted(x.latency_ms for x in batch.filter((F.col("endpoint") == r.endpoint) & (F.col("ts") >= F.lit(r.window_start)) & (F.col("ts") < F.lit(r.window_end))).collect()) if r is windows[0] else None
            if mine:
                for p, v in ((0.5, r.p50_ms), (0.95, r.p95_ms)):
                    assert np.searchsorted(mine, v, "left") / len(mine) - 0.02 <= p <= np.searchsorted(mine, v, "right") / len(mine) + 0.02


def test_ingest(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("log", "table", "c"))
    (tmp_path / "log").mkdir()

    def add(name, *lines):
        (tmp_path / "log" / name).write_text("\n".join(lines) + "\n")

    def run():
        finish(ingest.ingest_request_log(spark, source, target, mark, available_now=True))
        return spark.read.parquet(target)

    good = [json.dumps({"ts": f"2026-02-1{d}T01:02:03Z", "endpoint": "/ask", "status_code": 200}) for d in (6, 7)]
    add("1.jsonl", good[0], "", "{broken", "7")
    assert run().count() == 1
    add("2.jsonl", good[1], '{"status_code": "x"}')
    table = run()
    assert table.count() == 3
    assert sorted(str(r.day) for r in table.collect()) == ["2026-02-16", "2026-02-17", "None"]
    lines = spark.read.text(source)
    assert sorted(r.status_code for r in parse_log_lines(lines).collect()) == [0, 200, 200]
