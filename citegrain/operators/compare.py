"""Baseline against candidate: run aggregates, paired deltas, metric tables and the gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrain.functions.text import strip
from citegrain.functions.values import lenient_float, lenient_int, ratio

# The smallest change that counts, the compared metrics and the verdicts.
MIN_DELTA = 1e-9
RETRIEVAL_METRICS = ("search_hit_rate", "ask_hit_rate", "avg_keyword_recall")
QUALITY_METRICS = (
    "http_success_rate",
    "format_ok_rate",
    "citation_compliance_rate",
    "expected_doc_cited_rate",
    "avg_keyword_recall",
    "avg_latency_ms",
)
DROP_RULES = (
    ("http_success_rate", "Do not keep candidate: HTTP success rate regressed."),
    ("format_ok_rate", "Do not keep candidate: format compliance regressed."),
    ("citation_compliance_rate", "Do not keep candidate: citation compliance regressed."),
)
KEEP = "Keep candidate: quality metrics improved or held with better keyword recall."
REVIEW = (
    "Candidate is acceptable on structure/citation but keyword recall regressed; review detail CSV."
)


def run_aggregate(detail: DataFrame) -> DataFrame:
    """Rates over all raw detail rows: duplicates and failures count, blanks are 0."""
    total = F.count("*")
    return detail.agg(
        total.cast("double").alias("total"),
        ratio(F.sum(lenient_int("search_hit_expected_doc")), total).alias("search_hit_rate"),
        ratio(F.sum(lenient_int("ask_hit_expected_doc")), total).alias("ask_hit_rate"),
        ratio(F.sum(lenient_float("keyword_recall")), total).alias("avg_keyword_recall"),
    )


def last_per_id(detail: DataFrame, sequence: str, key: str = "id") -> DataFrame:
    """The last row of every stripped id by *sequence*; blank ids are dropped.

    Each task passes on at most one row per id, so a repeated id does not pile up.
    """
    rows = detail.withColumn(key, strip(F.col(key).cast("string"))).filter(F.col(key) != "")
    newest = Window.partitionBy(key).orderBy(F.desc(sequence))
    return (
        rows.withColumn("_place", F.row_number().over(newest))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def paired_deltas(baseline: DataFrame, candidate: DataFrame, sequence: str, key: str = "id") -> DataFrame:
    """Ids in both runs in numeric order, with the change in recall and its class."""

    def side(run: DataFrame, name: str, *more: str) -> DataFrame:
        return last_per_id(run, sequence, key).select(
            key,
            *more,
            lenient_float("keyword_recall").alias(f"{name}_kw"),
            F.coalesce("ask_source_docs", F.lit("")).alias(f"{name}_docs"),
        )

    delta = F.col("candidate_kw") - F.col("baseline_kw")
    paired = side(baseline, "baseline").join(side(candidate, "candidate", "query"), key)
    return paired.select(
        key,
        "query",
        "baseline_kw",
        "candidate_kw",
        delta.alias("delta_kw"),
        "baseline_docs",
        "candidate_docs",
        F.when(delta > MIN_DELTA, "improved")
        .when(delta < -MIN_DELTA, "regressed")
        .otherwise("unchanged")
        .alias("change"),
    ).orderBy(F.col(key).try_cast("bigint"), key)


def change_counts(deltas: DataFrame) -> DataFrame:
    """The number of improved, regressed and unchanged ids, in one row."""
    return deltas.agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("improved", "regressed", "unchanged")]
    )


def with_change(deltas: DataFrame, change: str) -> DataFrame:
    return deltas.filter(F.col("change") == change)


def metric_table(
    baseline: DataFrame, candidate: DataFrame, metrics: Sequence[str] = RETRIEVAL_METRICS
) -> DataFrame:
    """One row per metric from two one-row summaries; a missing metric is 0.0."""

    def long(summary: DataFrame, value: str) -> DataFrame:
        cells = [
            (F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if m in summary.columns else F.lit(0.0)).alias(m)
            for m in metrics
        ]
        return summary.select(*cells).unpivot([], list(metrics), "metric", value)

    place = F.array_position(F.lit(list(metrics)), F.col("metric"))
    both = long(baseline, "baseline").join(long(candidate, "candidate"), "metric")
    return both.withColumn("delta", F.col("candidate") - F.col("baseline")).orderBy(place)


def recommendation(metrics: DataFrame) -> DataFrame:
    """Keep, drop or review, from a metric table; the first rule that applies decides."""

    def value(side: str, metric: str):
        return F.coalesce(F.max(F.when(F.col("metric") == metric, F.col(side))), F.lit(0.0))

    verdict = None
    for metric, text in DROP_RULES:
        fell = value("candidate", metric) < value("baseline", metric)
        verdict = F.when(fell, text) if verdict is None else verdict.when(fell, text)
    held = value("candidate", "avg_keyword_recall") >= value("baseline", "avg_keyword_recall")
    return metrics.agg(verdict.when(held, KEEP).otherwise(REVIEW).alias("recommendation"))
