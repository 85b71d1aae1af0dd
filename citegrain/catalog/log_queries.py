"""Request-log queries over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrain.catalog.views import request_log, with_views
from citegrain.operators import logs


def _flags(df):
    return df.withColumns({c: F.col(c).cast("int") for c in ("pass_error", "pass_latency", "passed")})


def _rounded_slo(df):
    return _flags(df).withColumns(
        {"error_rate": F.round("error_rate", 6), "p95_ms": F.round("p95_ms", 6)}
    )


def _utc(df, *names):
    """Times as UTC text: a timestamp with zone and one without compare as equal text."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS") for n in names})


QUERIES = {
    "h14_slo_by_endpoint": lambda s, d: _rounded_slo(logs.slo_check(request_log(s, d), ["endpoint"])),
    "h14_slo_whole_log": lambda s, d: _rounded_slo(logs.slo_check(request_log(s, d))),
    "b8_h14_slo_ask_only": lambda s, d: _rounded_slo(logs.slo_check(request_log(s, d), ask_only=True)),
    "h1_requests_by_endpoint": lambda s, d: logs.requests_by(request_log(s, d), "endpoint"),
    "h1_requests_by_provider": lambda s, d: logs.requests_by(request_log(s, d), "provider"),
    "h2_top_queries": lambda s, d: logs.top_queries(request_log(s, d)),
    "h3_top_source_docs": lambda s, d: logs.top_source_docs(request_log(s, d)),
    "h4_top_prompt_styles": lambda s, d: logs.top_prompt_styles(request_log(s, d)),
    "h5_error_rate": lambda s, d: logs.error_rate(request_log(s, d)),
    "h6_latency_stats": lambda s, d: logs.latency_stats(request_log(s, d)),
    "h6_latency_by_provider": lambda s, d: logs.latency_stats(request_log(s, d), ["provider"]),
    "h7_recent_latency": lambda s, d: logs.recent_latency_stats(request_log(s, d)),
    "h8_endpoint_stats": lambda s, d: logs.endpoint_stats(request_log(s, d)),
    "h9_cache_stats": lambda s, d: logs.cache_stats(request_log(s, d)),
    "h10_time_range": lambda s, d: _utc(logs.time_range(request_log(s, d)), "first_ts", "last_ts"),
    "h11_slowest_requests": lambda s, d: _utc(logs.slowest_requests(request_log(s, d)), "ts"),
    "h12_error_samples": lambda s, d: _utc(logs.error_samples(request_log(s, d)), "ts"),
    "h13_log_summary": lambda s, d: logs.log_summary(request_log(s, d)),
    "h13_log_report": lambda s, d: _utc(logs.log_report(request_log(s, d)), "first_ts", "last_ts"),
}

SQL_UTC = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_TS = SQL_UTC.format("ts")


def _slo(where: str = "", group: str = "") -> str:
    head = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
        SELECT {head}requests, errors, round(rate, 6) AS error_rate, round(p95, 6) AS p95_ms,
          CAST(rate <= 0.02 AS INT) AS pass_error, CAST(p95 <= 3000 AS INT) AS pass_latency,
          CAST(rate <= 0.02 AND p95 <= 3000 AS INT) AS passed
        FROM (SELECT {head}count(*) AS requests,
                CAST(count(*) FILTER (status_code >= 400) AS BIGINT) AS errors,
                count(*) FILTER (status_code >= 400) / count(*) AS rate,
                quantile_cont(latency_ms, 0.95) AS p95
              FROM request_log {where} {tail})"""


def _counts(column: str, source: str = "request_log", limit: str = "") -> str:
    return f"""
        SELECT {column}, count(*) AS requests FROM {source} WHERE {column} <> ''
        GROUP BY {column} ORDER BY requests DESC, {column} {limit}"""


def _latency(n: str = "requests") -> str:
    return f"""count(*) AS {n}, round(avg(latency_ms), 3) AS avg_latency_ms,
        round(quantile_cont(latency_ms, 0.5), 3) AS p50_latency_ms,
        round(quantile_cont(latency_ms, 0.95), 3) AS p95_latency_ms"""


_RECENT = "(SELECT * FROM request_log ORDER BY ts DESC, event_id DESC LIMIT 1000)"

_SQL = {
    "h14_slo_by_endpoint": _slo(group="endpoint"),
    "h14_slo_whole_log": _slo(),
    "b8_h14_slo_ask_only": _slo(where="WHERE endpoint = '/ask'"),
    "h1_requests_by_endpoint": _counts("endpoint"),
    "h1_requests_by_provider": _counts("provider"),
    "h2_top_queries": _counts("query", limit="LIMIT 5"),
    "h3_top_source_docs": _counts(
        "doc_name", "(SELECT unnest(source_docs) AS doc_name FROM request_log)", "LIMIT 5"
    ),
    "h4_top_prompt_styles": _counts("prompt_style", limit="LIMIT 5"),
    "h5_error_rate": """
        SELECT count(*) AS total_requests, count(*) FILTER (status_code >= 400) AS total_errors,
          round(count(*) FILTER (status_code >= 400) / count(*), 4) AS error_rate FROM request_log""",
    "h6_latency_stats": f"SELECT {_latency()} FROM request_log",
    "h6_latency_by_provider": f"SELECT provider, {_latency()} FROM request_log GROUP BY provider",
    "h7_recent_latency": f"SELECT {_latency('recent_requests')} FROM {_RECENT}",
    "h8_endpoint_stats": """
        SELECT endpoint, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors,
          round(count(*) FILTER (status_code >= 400) / count(*), 4) AS error_rate
        FROM request_log GROUP BY endpoint""",
    "h9_cache_stats": """
        SELECT count(*) AS checks, count(*) FILTER (cache_hit) AS hits,
          round(count(*) FILTER (cache_hit) / count(*), 4) AS hit_rate
        FROM request_log WHERE endpoint = '/ask'""",
    "h10_time_range": f"""
        SELECT {SQL_UTC.format('min(ts)')} AS first_ts, {SQL_UTC.format('max(ts)')} AS last_ts
        FROM request_log""",
    "h11_slowest_requests": f"""
        SELECT {_TS} AS ts, event_id, endpoint, status_code, latency_ms, query
        FROM request_log ORDER BY latency_ms DESC, request_log.ts, event_id LIMIT 5""",
    "h12_error_samples": f"""
        SELECT {_TS} AS ts, event_id, endpoint, status_code, replace(error, '|', '/') AS error, query
        FROM request_log WHERE status_code >= 400 ORDER BY request_log.ts, event_id LIMIT 5""",
    "h13_log_summary": f"""
        SELECT t.*, avg_latency_ms, p50_latency_ms, p95_latency_ms
        FROM (SELECT count(*) AS total_requests,
                count(*) FILTER (status_code >= 400) AS total_errors,
                round(count(*) FILTER (status_code >= 400) / count(*), 4) AS error_rate,
                count(*) FILTER (endpoint = '/ask') AS cache_checks,
                count(*) FILTER (endpoint = '/ask' AND cache_hit) AS cache_hits,
                round(count(*) FILTER (endpoint = '/ask' AND cache_hit)
                  / count(*) FILTER (endpoint = '/ask'), 4) AS cache_hit_rate
              FROM request_log) t, (SELECT {_latency()} FROM {_RECENT})""",
    "h13_log_report": f"""
        SELECT count(*) AS total_requests, count(*) FILTER (status_code >= 400) AS total_errors,
          round(count(*) FILTER (status_code >= 400) / count(*), 4) AS error_rate,
          round(avg(latency_ms), 3) AS avg_latency_ms,
          round(quantile_cont(latency_ms, 0.5), 3) AS p50_latency_ms,
          round(quantile_cont(latency_ms, 0.95), 3) AS p95_latency_ms,
          {SQL_UTC.format('min(ts)')} AS first_ts, {SQL_UTC.format('max(ts)')} AS last_ts
        FROM request_log""",
}

SQL = {name: with_views(sql, "request_log") for name, sql in _SQL.items()}
