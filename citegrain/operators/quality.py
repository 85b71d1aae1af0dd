"""Answer-quality evaluation: format, citation compliance, cited document, keyword recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import chunk_label, hard_preview, split_list, strip
from citegrain.functions.values import flag, keyword_recall, non_empty_subset, ratio

# Confidence levels, the status of a good response and the preview length.
CONFIDENCE_LEVELS = ("low", "medium", "high")
OK_STATUS = 200
ANSWER_CHARS = 220


def source_labels(sources: Column) -> Column:
    """Labels of the sources that name both a document and a chunk; order and repeats kept."""
    named = F.filter(
        F.transform(
            sources,
            lambda s: F.struct(
                strip(F.coalesce(s["doc_name"].cast("string"), F.lit(""))).alias("doc"),
                strip(F.coalesce(s["chunk_id"].cast("string"), F.lit(""))).alias("chunk"),
            ),
        ),
        lambda s: (s["doc"] != "") & (s["chunk"] != ""),
    )
    return F.transform(named, lambda s: chunk_label(s["doc"], s["chunk"]))


def citation_set(citations: Column) -> Column:
    """Stripped, non-blank, distinct, sorted; a missing list is empty."""
    items = F.coalesce(citations, F.array().cast("array<string>"))
    kept = F.filter(F.transform(items, strip), lambda c: c != "")
    return F.array_sort(F.array_distinct(kept))


def quality_detail(
    questions: DataFrame, responses: DataFrame, key: str = "qid", extra: Sequence[str] = ()
) -> DataFrame:
    """One scored row per question.

    *questions*: key, query, expected_doc, expected_keywords; *responses*: key, http_status,
    latency_ms, error and the answer record's columns. A question without a response, or
    with a status other than 200, scores zeros and blanks. *extra* names response columns to
    keep, such as a run's tag.
    """
    asked = questions.select(
        key,
        strip("query").alias("query"),
        strip("expected_doc").alias("expected_doc"),
        split_list("expected_keywords").alias("keywords"),
    )
    told = responses.select(
        key,
        "http_status",
        "latency_ms",
        "error",
        "answer",
        "confidence",
        F.col("prompt_style"),
        citation_set(F.col("citations")).alias("citation_set"),
        F.coalesce(source_labels(F.col("sources")), F.array().cast("array<string>")).alias("labels"),
        *extra,
    )
    rows = asked.join(told, key, "left")
    answer = F.coalesce("answer", F.lit(""))
    confidence = strip(F.lower(F.coalesce("confidence", F.lit(""))))
    ok = F.coalesce(F.col("http_status") == OK_STATUS, F.lit(False))
    cites = F.col("citation_set")
    prefix = F.concat("expected_doc", F.lit("#"))

    def when_ok(value: Column, otherwise) -> Column:
        return F.when(ok, value).otherwise(F.lit(otherwise))

    return rows.select(
        F.col(key).alias("id"),
        *extra,
        "query",
        "expected_doc",
        F.coalesce("http_status", F.lit(0)).alias("http_status"),
        F.round(F.coalesce("latency_ms", F.lit(0.0)), 3).alias("latency_ms"),
        when_ok(flag((strip(answer) != "") & confidence.isin(*CONFIDENCE_LEVELS)), 0).alias("format_ok"),
        when_ok(flag(non_empty_subset(cites, F.col("labels"))), 0).alias("citation_compliant"),
        when_ok(flag(F.exists(cites, lambda c: F.startswith(c, prefix))), 0).alias("expected_doc_cited"),
        when_ok(keyword_recall(answer, F.col("keywords")), 0.0).alias("keyword_recall"),
        when_ok(confidence, "").alias("confidence"),
        when_ok(strip(F.coalesce("prompt_style", F.lit(""))), "").alias("prompt_style_resp"),
        when_ok(F.array_join(cites, "|"), "").alias("citations"),
        when_ok(F.array_join("labels", "|"), "").alias("source_labels"),
        when_ok(hard_preview(answer, ANSWER_CHARS), "").alias("answer_preview"),
        F.coalesce("error", F.lit("")).alias("error"),
        when_ok(F.col("answer").isNotNull(), False).alias("answered"),
    )


def quality_rows(detail: DataFrame) -> DataFrame:
    """The detail table as shown: recall to 3 places, helper column gone."""
    return detail.withColumn("keyword_recall", F.round("keyword_recall", 3)).drop("answered")


def quality_summary(detail: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates to 4 places and mean latency to 3 over all rows, failures included.

    With *by*, say a prompt style and a tag, one row per run.
    """
    total = F.count("*")

    def rate(column: Column, name: str) -> Column:
        return F.round(ratio(F.sum(column), total), 4).alias(name)

    return detail.groupBy(*by).agg(
        total.alias("total"),
        rate(F.col("answered").cast("int"), "http_success_rate"),
        rate(F.col("format_ok"), "format_ok_rate"),
        rate(F.col("citation_compliant"), "citation_compliance_rate"),
        rate(F.col("expected_doc_cited"), "expected_doc_cited_rate"),
        rate(F.col("keyword_recall"), "avg_keyword_recall"),
        F.round(ratio(F.sum("latency_ms"), total), 3).alias("avg_latency_ms"),
    )
