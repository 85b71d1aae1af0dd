"""All registered queries in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citegrain.catalog import (
    answer_queries,
    log_queries,
    retrieval_queries,
    reuse_queries,
    source_queries,
    stream_queries,
    tool_queries,
)

FLAGSHIP = "c6_hit_rows"

FAMILIES = (
    source_queries,
    retrieval_queries,
    answer_queries,
    reuse_queries,
    log_queries,
    tool_queries,
    stream_queries,
)

# What the registered queries rely on: times are UTC, and streaming state lives in RocksDB.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name, value in SESSION_SETTINGS.items():
            spark.conf.set(name, value)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(q) for family in FAMILIES for name, q in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
