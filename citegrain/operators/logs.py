"""Request-log analytics: rankings, latency percentiles, summaries and the service-level check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import strip
from citegrain.functions.values import ratio
from citegrain.plans.percentiles import value_profile
from citegrain.sources.request_log import LOG_ORDER

# Default service-level targets, ranking sizes and the latency window.
MAX_ERROR_RATE = 0.02
MAX_P95_MS = 3000.0
TOP_N = 5
RECENT_REQUESTS = 1000
ERROR_STATUS = 400
ASK_ENDPOINT = "/ask"


def is_error() -> Column:
    return F.col("status_code") >= ERROR_STATUS


def only_endpoint(log: DataFrame, endpoint: str = ASK_ENDPOINT) -> DataFrame:
    return log.filter(F.col("endpoint") == endpoint)


def _ranked(items: DataFrame, name: str, top_n: int | None) -> DataFrame:
    """Non-blank items with their counts, most frequent first, ties by name."""
    counted = items.filter(F.col(name) != "").groupBy(name).agg(F.count("*").alias("requests"))
    ordered = counted.orderBy(F.desc("requests"), F.asc(name))
    return ordered if top_n is None else ordered.limit(top_n)


def requests_by(log: DataFrame, column: str) -> DataFrame:
    """Requests per endpoint, provider or any other text column."""
    return _ranked(log.select(column), column, None)


def top_queries(log: DataFrame, top_n: int = TOP_N) -> DataFrame:
    return _ranked(log.select(strip("query").alias("query")), "query", top_n)


def top_source_docs(log: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """A document listed twice in one request counts twice."""
    return _ranked(log.select(F.explode("source_docs").alias("doc_name")), "doc_name", top_n)


def top_prompt_styles(log: DataFrame, top_n: int = TOP_N) -> DataFrame:
    return _ranked(log.select("prompt_style"), "prompt_style", top_n)


def error_rate(log: DataFrame) -> DataFrame:
    errors, total = F.count_if(is_error()), F.count("*")
    return log.agg(
        total.alias("total_requests"),
        errors.alias("total_errors"),
        F.round(ratio(errors, total), 4).alias("error_rate"),
    )


def _latency_columns(percentiles: Sequence[float]) -> list[Column]:
    return [
        F.round(ratio(F.col("value_sum"), F.col("total")), 3).alias("avg_latency_ms"),
        *[F.round(f"p{p:g}", 3).alias(f"p{p:g}_latency_ms") for p in percentiles],
    ]


def latency_stats(
    log: DataFrame, by: Sequence[str] = (), percentiles: Sequence[float] = (50, 95)
) -> DataFrame:
    """Mean and exact percentiles over the whole log, or per group."""
    profile = value_profile(log, "latency_ms", percentiles, by)
    return profile.select(
        *by, F.col("total").alias("requests"), *_latency_columns(percentiles)
    )


def approximate_latency_stats(
    log: DataFrame, by: Sequence[str] = (), percentiles: Sequence[float] = (50, 95), accuracy: int = 10000
) -> DataFrame:
    """One-pass form of `latency_stats`; a percentile's rank may be off by 1/accuracy of the rows."""
    points = F.percentile_approx(
        "latency_ms", [p / 100.0 for p in percentiles], accuracy
    )
    return (
        log.groupBy(*by)
        .agg(F.count("*").alias("requests"), F.avg("latency_ms").alias("mean"), points.alias("points"))
        .select(
            *by,
            "requests",
            F.round(F.coalesce("mean", F.lit(0.0)), 3).alias("avg_latency_ms"),
            *[
                F.round(F.coalesce(F.get("points", F.lit(i)), F.lit(0.0)), 3).alias(f"p{p:g}_latency_ms")
                for i, p in enumerate(percentiles)
            ],
        )
    )


def log_order(log: DataFrame, order: Sequence[str] | None = None) -> list[str]:
    """The columns that put a log in order: the given ones, else those of a log read from files, else time
    and event number, as far as the log has them."""
    if order:
        return list(order)
    if set(LOG_ORDER) <= set(log.columns):
        return list(LOG_ORDER)
    return [c for c in ("ts", "event_id") if c in log.columns]


def recent_requests(
    log: DataFrame, order: Sequence[str] | None = None, last_n: int = RECENT_REQUESTS
) -> DataFrame:
    return log.orderBy(*[F.desc(c) for c in log_order(log, order)]).limit(last_n)


def recent_latency_stats(
    log: DataFrame, order: Sequence[str] | None = None, last_n: int = RECENT_REQUESTS
) -> DataFrame:
    """Mean, p50 and p95 over the last *last_n* requests only, a window of fixed size."""
    order = log_order(log, order)
    points = F.percentile("latency_ms", [0.5, 0.95])
    return (
        recent_requests(log.select(*order, "latency_ms"), order, last_n)
        .agg(F.count("*").alias("recent_requests"), F.avg("latency_ms").alias("mean"), points.alias("points"))
        .select(
            "recent_requests",
            F.round(F.coalesce("mean", F.lit(0.0)), 3).alias("avg_latency_ms"),
            F.round(F.coalesce(F.get("points", F.lit(0)), F.lit(0.0)), 3).alias("p50_latency_ms"),
            F.round(F.coalesce(F.get("points", F.lit(1)), F.lit(0.0)), 3).alias("p95_latency_ms"),
        )
    )


def endpoint_stats(log: DataFrame) -> DataFrame:
    errors, total = F.count_if(is_error()), F.count("*")
    return (
        log.groupBy("endpoint")
        .agg(
            total.alias("requests"),
            errors.alias("errors"),
            F.round(ratio(errors, total), 4).alias("error_rate"),
        )
        .orderBy(F.desc("requests"), F.asc("endpoint"))
    )


def cache_stats(log: DataFrame) -> DataFrame:
    """Every /ask request is a check, whether or not reuse was switched on."""
    asked = F.col("endpoint") == ASK_ENDPOINT
    checks, hits = F.count_if(asked), F.count_if(asked & F.col("cache_hit"))
    return log.agg(
        checks.alias("checks"), hits.alias("hits"), F.round(ratio(hits, checks), 4).alias("hit_rate")
    )


def time_range(log: DataFrame) -> DataFrame:
    """First and last request time; unparsable times are NULL and so ignored."""
    return log.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def slowest_requests(
    log: DataFrame, top_n: int = TOP_N, order: Sequence[str] | None = None
) -> DataFrame:
    order = log_order(log, order)
    columns = dict.fromkeys([*order, "ts", "endpoint", "status_code", "latency_ms", "query"])
    return log.select(*columns).orderBy(F.desc("latency_ms"), *order).limit(top_n)


def error_samples(
    log: DataFrame, top_n: int = TOP_N, order: Sequence[str] | None = None
) -> DataFrame:
    """The first errors in log order; ``|`` in a message becomes ``/`` to fit a table cell."""
    order = log_order(log, order)
    columns = dict.fromkeys([*order, "ts", "endpoint", "status_code", "error", "query"])
    return (
        log.filter(is_error())
        .select(*columns)
        .withColumn("error", F.replace("error", F.lit("|"), F.lit("/")))
        .orderBy(*order)
        .limit(top_n)
    )


def log_summary(
    log: DataFrame, order: Sequence[str] | None = None, last_n: int = RECENT_REQUESTS
) -> DataFrame:
    """Totals over the whole log and latency over its last requests, in one row.

    An empty log gives zeros. Both parts are one row each and are put side by side by an
    aggregate over their union.
    """
    asked = F.col("endpoint") == ASK_ENDPOINT
    total, errors = F.count("*"), F.count_if(is_error())
    checks, hits = F.count_if(asked), F.count_if(asked & F.col("cache_hit"))
    totals = log.agg(
        total.alias("total_requests"),
        errors.alias("total_errors"),
        F.round(ratio(errors, total), 4).alias("error_rate"),
        checks.alias("cache_checks"),
        hits.alias("cache_hits"),
        F.round(ratio(hits, checks), 4).alias("cache_hit_rate"),
    )
    recent = recent_latency_stats(log, order, last_n).drop("recent_requests")
    both = totals.unionByName(recent, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def log_report(log: DataFrame, percentiles: Sequence[float] = (50, 95)) -> DataFrame:
    """Head of the offline report: totals and latency over the whole log, and its time range, in one read."""
    profile = value_profile(
        log.withColumn("failed", is_error()), "latency_ms", percentiles, errors="failed", spread="ts"
    )
    return profile.select(
        F.col("total").alias("total_requests"),
        F.col("errors").alias("total_errors"),
        F.round(ratio(F.col("errors"), F.col("total")), 4).alias("error_rate"),
        *_latency_columns(percentiles),
        F.col("spread_min").alias("first_ts"),
        F.col("spread_max").alias("last_ts"),
    )


def with_verdict(
    stats: DataFrame, max_error_rate: float = MAX_ERROR_RATE, max_p95_ms: float = MAX_P95_MS
) -> DataFrame:
    """Verdict per rule and overall, from the columns ``error_rate`` and ``p95_ms``."""
    error_ok = F.col("error_rate") <= max_error_rate
    latency_ok = F.col("p95_ms") <= max_p95_ms
    return stats.withColumns(
        {"pass_error": error_ok, "pass_latency": latency_ok, "passed": error_ok & latency_ok}
    )


def slo_check(
    log: DataFrame,
    by: Sequence[str] = (),
    max_error_rate: float = MAX_ERROR_RATE,
    max_p95_ms: float = MAX_P95_MS,
    ask_only: bool = False,
) -> DataFrame:
    """Error rate and p95 against their targets, for the log or per group.

    Checking a log without rows is an error, raised when the result is read.
    """
    rows = only_endpoint(log) if ask_only else log
    profile = value_profile(
        rows.withColumn("failed", is_error()), "latency_ms", (95,), by, errors="failed"
    )
    total = F.when(
        F.col("total") == 0, F.raise_error("no log rows available for the service-level check")
    ).otherwise(F.col("total"))
    stats = profile.select(
        *by,
        total.cast("bigint").alias("requests"),
        F.col("errors"),
        ratio(F.col("errors"), F.col("total")).alias("error_rate"),
        F.col("p95").alias("p95_ms"),
    )
    return with_verdict(stats, max_error_rate, max_p95_ms)
