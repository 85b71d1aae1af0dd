"""Answer reuse over the /ask requests of `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.catalog.views import request_log, with_views
from citegrain.operators import logs, reuse

DAY = 86400


def asked(s: SparkSession, d: str) -> DataFrame:
    key = reuse.reuse_key(F.col("provider"), F.col("prompt_style"), F.col("top_k"), F.col("query"))
    return logs.only_endpoint(request_log(s, d)).select("event_id", "ts", key.alias("key"))


def _reused(s: SparkSession, d: str, ttl: int, **how: int) -> DataFrame:
    marked = reuse.mark_reuse(asked(s, d), ["key"], ttl_sec=ttl, **how)
    return marked.select("event_id", "key", F.col("reused").cast("int").alias("reused"))


def _repeated(s: SparkSession, d: str, ttl: int) -> DataFrame:
    marked = reuse.mark_repeats(asked(s, d), ["key"], ttl_sec=ttl)
    return marked.select("event_id", "key", F.col("repeated").cast("int").alias("repeated"))


def _by_provider(s: SparkSession, d: str) -> DataFrame:
    """Few keys with dense traffic, each cut into many ranges."""
    rows = logs.only_endpoint(request_log(s, d)).select("event_id", "ts", F.col("provider").alias("key"))
    marked = reuse.mark_reuse(rows, ["key"], ttl_sec=3600, range_rows=2000)
    return marked.select("event_id", "key", F.col("reused").cast("int").alias("reused"))


QUERIES = {
    "e6_answer_reuse": lambda s, d: _reused(s, d, reuse.TTL_SEC),
    "e6_answer_reuse_one_day": lambda s, d: _reused(s, d, DAY),
    "e6_answer_reuse_hot_keys": _by_provider,
    "e7_repeated_requests": lambda s, d: _repeated(s, d, reuse.TTL_SEC),
    "e7_repeated_requests_one_day": lambda s, d: _repeated(s, d, DAY),
}

_ASKED = """
    SELECT event_id, epoch_us(ts) AS us, provider || '|' || prompt_style || '|' || top_k || '|' || query AS key
    FROM request_log WHERE endpoint = '/ask'"""
_PROVIDERS = "SELECT event_id, epoch_us(ts) AS us, provider AS key FROM request_log WHERE endpoint = '/ask'"


def sql_reuse(asked_sql: str, ttl: int) -> str:
    chain = f"""WITH RECURSIVE request_log AS (SELECT * FROM request_log_view),
        asked AS ({asked_sql}),
        stored AS (
          SELECT key, min(us) AS us FROM asked GROUP BY key
          UNION ALL
          SELECT a.key, min(a.us) FROM stored s JOIN asked a ON a.key = s.key AND a.us > s.us + {ttl * 1_000_000}
          GROUP BY a.key)
        SELECT event_id, a.key, CAST(s.us IS NULL OR row_number() OVER (PARTITION BY a.key, a.us ORDER BY event_id) > 1 AS INT) AS reused
        FROM asked a LEFT JOIN stored s ON s.key = a.key AND s.us = a.us"""
    view = with_views("SELECT * FROM request_log", "request_log")
    return chain.replace("(SELECT * FROM request_log_view)", f"({view})")


def _sql_repeats(ttl: int) -> str:
    return with_views(
        f"""SELECT event_id, key, CAST(coalesce(us <= lag(us) OVER (PARTITION BY key ORDER BY us, event_id)
              + {ttl * 1_000_000}, false) AS INT) AS repeated FROM asked""",
        "request_log",
        asked=_ASKED,
    )


SQL = {
    "e6_answer_reuse": sql_reuse(_ASKED, reuse.TTL_SEC),
    "e6_answer_reuse_one_day": sql_reuse(_ASKED, DAY),
    "e6_answer_reuse_hot_keys": sql_reuse(_PROVIDERS, 3600),
    "e7_repeated_requests": _sql_repeats(reuse.TTL_SEC),
    "e7_repeated_requests_one_day": _sql_repeats(DAY),
}
