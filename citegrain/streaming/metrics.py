"""Running totals and windowed metrics of a request stream.

Sinks write one folder per micro-batch and overwrite it when a batch is replayed, so a
restart after a lost executor or driver leaves every result there once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citegrain.functions.text import strip
from citegrain.functions.values import ratio
from citegrain.operators.logs import (
    ASK_ENDPOINT,
    MAX_ERROR_RATE,
    MAX_P95_MS,
    RECENT_REQUESTS,
    TOP_N,
    is_error,
    with_verdict,
)
from citegrain.plans.percentiles import value_profile

# Default lateness allowed to a request, and the default window.
DELAY = "10 minutes"
WINDOW = "1 hour"
# Items that a latency sketch keeps at a level.
SKETCH_K = 400


def running_totals(requests: DataFrame) -> DataFrame:
    """Requests, errors, cache checks and hits per endpoint, for complete or update mode."""
    asked = F.col("endpoint") == ASK_ENDPOINT
    return requests.groupBy("endpoint").agg(
        F.count("*").alias("requests"),
        F.count_if(is_error()).alias("errors"),
        F.count_if(asked).alias("cache_checks"),
        F.count_if(asked & F.col("cache_hit")).alias("cache_hits"),
    )


def window_counts(
    requests: DataFrame,
    window: str = WINDOW,
    slide: str | None = None,
    delay: str = DELAY,
    by: Sequence[str] = ("endpoint",),
) -> DataFrame:
    """Requests per window, group, latency value and outcome.

    Keeping the latency value in the key spreads a window's state over the cluster, where a
    percentile as the streaming aggregate would hold a whole group's values in one place.
    Takes a stream or a batch.
    """
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        requests.withWatermark("ts", delay)
        .groupBy(span.alias("window"), *by, "latency_ms", is_error().alias("failed"))
        .agg(F.count("*").alias("n"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *by,
            "latency_ms",
            "failed",
            "n",
        )
    )


def window_metrics(counts: DataFrame, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Count, error rate, mean and exact p50/p95 of each closed window and group."""
    group = ["window_start", "window_end", *by]
    profile = value_profile(counts, "latency_ms", (50, 95), group, errors="failed", weight="n")
    return profile.select(
        *group,
        F.col("total").alias("requests"),
        "errors",
        ratio(F.col("errors"), F.col("total")).alias("error_rate"),
        ratio(F.col("value_sum"), F.col("total")).alias("avg_ms"),
        F.col("p50").alias("p50_ms"),
        F.col("p95").alias("p95_ms"),
    )


def window_slo(
    counts: DataFrame,
    by: Sequence[str] = ("endpoint",),
    max_error_rate: float = MAX_ERROR_RATE,
    max_p95_ms: float = MAX_P95_MS,
) -> DataFrame:
    """The service-level verdict of each closed window and group."""
    return with_verdict(window_metrics(counts, by), max_error_rate, max_p95_ms)


def _start(stream: DataFrame, write: Callable, mode: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_closed_windows(
    counts: DataFrame,
    metrics: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Start a query that writes *metrics* of every window once the watermark has closed it.

    All counts of a window leave the state in the same micro-batch, so the percentiles made
    from one batch are those of whole windows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        if number == 0 or not batch.isEmpty():  # the first batch leaves the columns, whatever it holds
            metrics(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        batch.unpersist()

    return _start(counts, write, "append", checkpoint, available_now)


def write_snapshots(
    totals: DataFrame, target: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start a query that writes the complete totals after every micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _start(totals, write, "complete", checkpoint, available_now)


def latest_snapshot(spark: SparkSession, target: str) -> DataFrame:
    """The totals of the last micro-batch written."""
    rows = spark.read.parquet(target)
    newest = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), "batch", "left_semi").drop("batch")


def value_counts(requests: DataFrame) -> DataFrame:
    """Requests per query, prompt style and source document: kind, value, requests, for update mode.

    The counts are exact; their state is one row for each value, spread over the cluster.
    """
    of = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    none = F.array().cast("array<string>")
    docs = F.transform(F.coalesce("source_docs", none), lambda d: of("doc_name", d))
    items = F.concat(F.array(of("query", strip("query")), of("prompt_style", F.col("prompt_style"))), docs)
    rows = requests.select(F.explode(items).alias("item")).select("item.*").filter(F.col("value") != "")
    return rows.groupBy("kind", "value").agg(F.count("*").alias("requests"))


def write_changes(counts: DataFrame, target: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that writes the counts that each micro-batch changed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _start(counts, write, "update", checkpoint, available_now)


def top_values(spark: SparkSession, target: str, kind: str, top_n: int = TOP_N) -> DataFrame:
    """The most frequent values of a kind so far, ties by name; a count only grows, so its highest is its last."""
    rows = spark.read.parquet(target).filter(F.col("kind") == kind)
    counts = rows.groupBy(F.col("value").alias(kind)).agg(F.max("requests").alias("requests"))
    return counts.orderBy(F.desc("requests"), F.asc(kind)).limit(top_n)


def write_recent(
    requests: DataFrame,
    target: str,
    checkpoint: str,
    order: Sequence[str] = ("ts", "event_id"),
    last_n: int = RECENT_REQUESTS,
    available_now: bool = False,
) -> StreamingQuery:
    """Start a query that keeps the last *last_n* requests: after each micro-batch, of those kept and the new ones.

    Every task takes its last ones first, so what meets is tasks times *last_n* rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        if number:
            before = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/batch={number - 1}")
            batch = batch.unionByName(before)
        latest = batch.orderBy(*[F.desc(c) for c in order]).limit(last_n)
        latest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _start(requests.select(*order, "latency_ms"), write, "append", checkpoint, available_now)


def pane_sketches(
    requests: DataFrame, pane: str = WINDOW, delay: str = DELAY, by: Sequence[str] = ("endpoint",), k: int = SKETCH_K
) -> DataFrame:
    """Counts and a mergeable sketch of the latencies of each pane and group.

    The state is one row for each pane and group, however many different latencies there are. A quantile's rank
    is off by about 2.3 / *k* ** 0.9 of the rows at most; `window_counts` is the exact form.
    """
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", pane).alias("window"), *by)
        .agg(
            F.count("*").alias("requests"),
            F.count_if(is_error()).alias("errors"),
            F.sum("latency_ms").alias("latency_sum"),
            F.kll_sketch_agg_double("latency_ms", k).alias("sketch"),
        )
        .select(F.col("window.start").alias("pane_start"), *by, "requests", "errors", "latency_sum", "sketch")
    )


def merged_panes(panes: DataFrame, window: str, slide: str | None = None, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Windows made of whole panes: their sketches are merged, no row is looked at again."""
    span = F.window("pane_start", window, slide) if slide else F.window("pane_start", window)
    sums = panes.groupBy(span.alias("window"), *by).agg(
        F.sum("requests").alias("requests"),
        F.sum("errors").alias("errors"),
        F.sum("latency_sum").alias("latency_sum"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    return sums.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *by,
        "requests",
        "errors",
        ratio(F.col("errors"), F.col("requests")).alias("error_rate"),
        ratio(F.col("latency_sum"), F.col("requests")).alias("avg_ms"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}_ms") for p in (50, 95)],
    )
