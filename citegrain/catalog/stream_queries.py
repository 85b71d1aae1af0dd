"""Streams over `events`, run until all present input is read; results are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.catalog.log_queries import SQL as LOG_SQL
from citegrain.catalog.reuse_queries import _ASKED, DAY, sql_reuse
from citegrain.catalog.views import request_log, request_log_of, table, with_views
from citegrain.operators import logs, reuse
from citegrain.plans.workdir import shared_dir, written
from citegrain.sources.request_log import append_request_log
from citegrain.streaming import ingest, metrics
from citegrain.streaming.reuse import correct_stream_reuse, mark_stream_reuse


#: Micro-batches that the events come in, by time, at least; the rows that one is meant to have at most; and its files.
BATCHES = 4
BATCH_ROWS = 5_000_000
FILES = 8


def requests(s: SparkSession, d: str, late: bool = False) -> DataFrame:
    """The events as a stream, a micro-batch for each stretch of time; events without a time come first.

    A stretch is written as `FILES` files by as many tasks. With *late* every fiftieth event of the first stretch comes
    behind all others.
    """
    events, out = table(s, d, "events"), shared_dir(s)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.count()
    n = max(BATCHES, -(-rows // BATCH_ROWS))
    files = FILES if rows // n >= 100 * FILES else 1  # so that no file is missing from a micro-batch
    cuts = sorted(set(events.select(F.percentile_approx(at, [i / n for i in range(1, n)])).first()[0] or []))
    held = (F.col("event_id") % 50 == 7) if late and cuts else F.lit(False)
    stretches = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        from_low = F.lit(True) if low is None else at > low
        stretch = from_low if high is None else (from_low & (at <= high))
        stretches.append((at.isNull() | (stretch & ~held)) if low is None else stretch)
    if late and cuts:
        stretches.append((at <= cuts[0]) & held)
    for stretch in stretches:  # one after the other, since the source goes by file time
        events.filter(stretch).repartition(files, "event_id").write.mode("append").parquet(out)
    return request_log_of(s.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(out))


def _finished(query) -> None:
    query.awaitTermination()


def _totals(s: SparkSession, d: str) -> DataFrame:
    out = shared_dir(s)
    _finished(
        metrics.write_snapshots(
            metrics.running_totals(requests(s, d, late=True)), f"{out}/totals", f"{out}/checkpoint", True
        )
    )
    return metrics.latest_snapshot(s, f"{out}/totals")


def _windows(s: SparkSession, d: str, window: str, slide: str | None, make) -> DataFrame:
    out = shared_dir(s)
    counts = metrics.window_counts(requests(s, d), window, slide)
    _finished(
        metrics.write_closed_windows(counts, make, f"{out}/windows", f"{out}/checkpoint", True)
    )
    rows = s.read.parquet(f"{out}/windows").drop("batch")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    shown |= {c: F.round(c, 6) for c in ("error_rate", "avg_ms", "p50_ms", "p95_ms")}
    shown |= {c: F.col(c).cast("int") for c in ("pass_error", "pass_latency", "passed") if c in rows.columns}
    return rows.withColumns(shown)


def _reuse(s: SparkSession, d: str) -> DataFrame:
    out = shared_dir(s)
    key = reuse.reuse_key(F.col("provider"), F.col("prompt_style"), F.col("top_k"), F.col("query"))
    asked = logs.only_endpoint(requests(s, d)).select("event_id", "ts", key.alias("key"))
    _finished(
        mark_stream_reuse(asked)
        .writeStream.format("parquet")
        .option("path", f"{out}/reuse")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    return s.read.parquet(f"{out}/reuse").select(
        "event_id", "key", F.col("reused").cast("int").alias("reused")
    )


def _corrected(s: SparkSession, d: str) -> DataFrame:
    """Late requests judged in their place: the last revision of every row is what the batch says."""
    out = shared_dir(s)
    key = reuse.reuse_key(F.col("provider"), F.col("prompt_style"), F.col("top_k"), F.col("query"))
    asked = logs.only_endpoint(requests(s, d, late=True)).select("event_id", "ts", key.alias("key"))
    _finished(
        correct_stream_reuse(asked, ttl_sec=DAY, delay_sec=90 * DAY)
        .writeStream.format("parquet")
        .option("path", f"{out}/reuse")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    last = s.read.parquet(f"{out}/reuse").groupBy("event_id", "key").agg(F.max_by("reused", "revision").alias("reused"))
    return last.select("event_id", "key", F.col("reused").cast("int").alias("reused"))


def _live_tops(s: SparkSession, d: str) -> DataFrame:
    """The live counters of queries, styles and source documents, five of each."""
    out = shared_dir(s)
    counts = metrics.value_counts(requests(s, d, late=True))
    _finished(metrics.write_changes(counts, f"{out}/counts", f"{out}/checkpoint", True))
    tops = [
        metrics.top_values(s, f"{out}/counts", kind).select(F.lit(kind).alias("kind"), F.col(kind).alias("value"), "requests")
        for kind in ("query", "prompt_style", "doc_name")
    ]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


def _live_latency(s: SparkSession, d: str) -> DataFrame:
    out = shared_dir(s)
    _finished(metrics.write_recent(requests(s, d, late=True), f"{out}/recent", f"{out}/checkpoint", available_now=True))
    return logs.recent_latency_stats(metrics.latest_snapshot(s, f"{out}/recent"), ["ts", "event_id"])


#: How far the rank of a sketched percentile may be from the exact one.
RANK_ERROR = 0.02


def _sketched(s: SparkSession, d: str) -> DataFrame:
    """Sliding windows of two days merged from sketched panes of a day; are the ranks near enough?"""
    out = shared_dir(s)
    panes = metrics.pane_sketches(requests(s, d), "1 day")
    _finished(metrics.write_closed_windows(panes, lambda closed: closed, f"{out}/panes", f"{out}/checkpoint", True))
    windows = metrics.merged_panes(s.read.parquet(f"{out}/panes").drop("batch"), "2 days", "1 day")
    log = request_log(s, d)
    last = log.agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("mark"))
    windows = written(windows.join(F.broadcast(last), F.col("window_end") <= F.col("mark")).drop("mark"))
    placed = log.select(F.window("ts", "2 days", "1 day").alias("w"), "endpoint", "latency_ms").select(
        F.col("w.start").alias("window_start"), "endpoint", "latency_ms"
    )
    below = lambda p: F.avg((F.col("latency_ms") < F.col(p)).cast("double"))
    upto = lambda p: F.avg((F.col("latency_ms") <= F.col(p)).cast("double"))
    near = lambda p, rank: ((below(p) <= rank + RANK_ERROR) & (upto(p) >= rank - RANK_ERROR)).cast("int")
    # one row for each window and endpoint
    ranks = placed.join(F.broadcast(windows), ["window_start", "endpoint"]).groupBy("window_start", "endpoint").agg(
        F.count("*").alias("requests"), near("p50_ms", 0.5).alias("p50_near"), near("p95_ms", 0.95).alias("p95_near")
    )
    return ranks.join(windows.select("window_start", "endpoint", F.col("requests").alias("sketched"), "errors"), ["window_start", "endpoint"]).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "endpoint", "requests", "sketched", "errors", "p50_near", "p95_near"
    )


def _ingest(s: SparkSession, d: str) -> DataFrame:
    out = shared_dir(s)
    append_request_log(request_log(s, d), f"{out}/log")
    _finished(
        ingest.ingest_request_log(s, f"{out}/log", f"{out}/table", f"{out}/checkpoint", available_now=True)
    )
    rows = s.read.parquet(f"{out}/table")
    return rows.groupBy(F.col("day").cast("string").alias("day"), "endpoint").agg(
        F.count("*").alias("requests"), F.round(F.sum("latency_ms"), 3).alias("latency_sum")
    )


QUERIES = {
    "k1_running_totals": _totals,
    "k2_daily_windows": lambda s, d: _windows(s, d, "1 day", None, metrics.window_metrics),
    "k2_sliding_windows": lambda s, d: _windows(s, d, "2 days", "1 day", metrics.window_metrics),
    "k3_window_slo": lambda s, d: _windows(s, d, "12 hours", None, metrics.window_slo),
    "k1_live_tops": _live_tops,
    "k1_live_latency": _live_latency,
    "k2_sketched_windows": _sketched,
    "k4_stream_reuse": _reuse,
    "k4_corrected_reuse": _corrected,
    "a5_k5_log_ingest": _ingest,
}


def _window_sql(hours: int, slide_hours: int, verdict: bool = False) -> str:
    """Closed windows: those ending no later than the last time less the allowed delay."""
    step = slide_hours * 3600
    copies = hours // slide_hours
    more = """, CAST(error_rate <= 0.02 AS INT) AS pass_error, CAST(p95 <= 3000 AS INT) AS pass_latency,
        CAST(error_rate <= 0.02 AND p95 <= 3000 AS INT) AS passed""" if verdict else ""
    text = "strftime(make_timestamp(CAST({0} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"
    return with_views(
        f"""SELECT {text.format('start')} AS window_start, {text.format(f'start + {hours * 3600}')} AS window_end,
              endpoint, requests, errors, round(error_rate, 6) AS error_rate, round(mean, 6) AS avg_ms,
              round(p50, 6) AS p50_ms, round(p95, 6) AS p95_ms {more}
            FROM (SELECT start, endpoint, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors,
                    count(*) FILTER (status_code >= 400) / count(*) AS error_rate, avg(latency_ms) AS mean,
                    quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95
                  FROM (SELECT *, (epoch_us(ts) // {step * 1_000_000} - i) * {step} AS start
                        FROM request_log, range({copies}) r(i))
                  GROUP BY start, endpoint)
            WHERE start + {hours * 3600} <= (SELECT epoch_us(max(ts)) / 1000000 - 600 FROM request_log)""",
        "request_log",
    )


SQL = {
    "k1_running_totals": with_views(
        """SELECT endpoint, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors,
             count(*) FILTER (endpoint = '/ask') AS cache_checks,
             count(*) FILTER (endpoint = '/ask' AND cache_hit) AS cache_hits
           FROM request_log GROUP BY endpoint""",
        "request_log",
    ),
    "k2_daily_windows": _window_sql(24, 24),
    "k2_sliding_windows": _window_sql(48, 24),
    "k3_window_slo": _window_sql(12, 12, verdict=True),
    "k1_live_tops": with_views(
        """(SELECT 'query' AS kind, trim(query) AS value, count(*) AS requests FROM request_log
            WHERE trim(query) <> '' GROUP BY value ORDER BY requests DESC, value LIMIT 5)
           UNION ALL (SELECT 'prompt_style', prompt_style AS value, count(*) AS requests FROM request_log
            WHERE prompt_style <> '' GROUP BY value ORDER BY requests DESC, value LIMIT 5)
           UNION ALL (SELECT 'doc_name', value, count(*) AS requests FROM (SELECT unnest(source_docs) AS value FROM request_log)
            WHERE value <> '' GROUP BY value ORDER BY requests DESC, value LIMIT 5)""",
        "request_log",
    ),
    "k1_live_latency": LOG_SQL["h7_recent_latency"],
    "k2_sketched_windows": with_views(
        """SELECT strftime(make_timestamp(CAST(start AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, endpoint,
             count(*) AS requests, count(*) AS sketched, count(*) FILTER (status_code >= 400) AS errors,
             CAST(1 AS INT) AS p50_near, CAST(1 AS INT) AS p95_near
           FROM (SELECT *, (epoch_us(ts) // 86400000000 - i) * 86400 AS start FROM request_log, range(2) r(i))
           GROUP BY start, endpoint
           HAVING start + 172800 <= (SELECT epoch_us(max(ts)) / 1000000 - 600 FROM request_log)""",
        "request_log",
    ),
    "k4_stream_reuse": sql_reuse(_ASKED, reuse.TTL_SEC),
    "k4_corrected_reuse": sql_reuse(_ASKED, DAY),
    "a5_k5_log_ingest": with_views(
        """SELECT strftime(ts, '%Y-%m-%d') AS day, endpoint, count(*) AS requests,
             round(sum(latency_ms), 3) AS latency_sum FROM request_log GROUP BY ALL""",
        "request_log",
    ),
}
