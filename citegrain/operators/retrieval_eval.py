"""Retrieval evaluation over a labelled question set: hit@k, source hit@k, keyword recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import hard_preview, split_list, strip
from citegrain.functions.values import flag, keyword_recall, ratio

# The status of a good response, of a request never made, and the preview length.
OK_STATUS = 200
NOT_ASKED = -1
ANSWER_CHARS = 200


def scored_questions(
    questions: DataFrame, hits: DataFrame, answers: DataFrame | None = None, key: str = "qid"
) -> DataFrame:
    """Every question with its hit documents, flags and unrounded recall.

    *questions*: key, query, expected_doc, expected_keywords (``;``-separated), optionally
    notes; *hits*: key, rank, doc_name; *answers*: key, http_status, answer, sources. The key
    is unique in questions and answers. A question without hits or answer scores 0.
    """
    found = hits.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "doc_name"))), lambda h: h["doc_name"]
        ).alias("search_docs")
    )
    notes = F.col("notes") if "notes" in questions.columns else F.lit("")
    none = F.array().cast("array<string>")
    rows = (
        questions.select(
            key,
            strip("query").alias("query"),
            strip("expected_doc").alias("expected_doc"),
            split_list("expected_keywords").alias("keywords"),
            notes.alias("notes"),
        )
        .join(found, key, "left")
        .withColumn("search_docs", F.coalesce("search_docs", none))
        .withColumn("search_hit", flag(F.array_contains("search_docs", F.col("expected_doc"))))
    )
    if answers is None:
        return rows
    told = answers.select(
        key,
        F.col("http_status").alias("ask_status"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.transform("sources", lambda s: s["doc_name"]).alias("ask_docs"),
    )
    rows = rows.join(told, key, "left").withColumns(
        {
            "ask_status": F.coalesce("ask_status", F.lit(NOT_ASKED)),
            "answer": F.coalesce("answer", F.lit("")),
            "ask_docs": F.coalesce("ask_docs", none),
        }
    )
    return rows.withColumns(
        {
            "ask_hit": flag(F.array_contains("ask_docs", F.col("expected_doc"))),
            "recall": F.when(
                F.col("ask_status") == OK_STATUS, keyword_recall("answer", "keywords")
            ).otherwise(0.0),
        }
    )


def eval_detail(scored: DataFrame, key: str = "qid") -> DataFrame:
    """The detail table; a retrieval-only run leaves the answer columns blank."""
    asked = "recall" in scored.columns
    blank = F.lit("")
    return scored.select(
        F.col(key).alias("id"),
        "query",
        "expected_doc",
        F.lit(OK_STATUS).alias("search_status"),
        F.array_join("search_docs", "|").alias("search_docs"),
        F.col("search_hit").alias("search_hit_expected_doc"),
        (F.col("ask_status") if asked else blank).alias("ask_status"),
        (F.array_join("ask_docs", "|") if asked else blank).alias("ask_source_docs"),
        (F.col("ask_hit") if asked else blank).alias("ask_hit_expected_doc"),
        (F.round("recall", 3) if asked else blank).alias("keyword_recall"),
        (hard_preview("answer", ANSWER_CHARS) if asked else blank).alias("answer_preview"),
        blank.alias("manual_answer_score_0_2"),
        blank.alias("manual_source_score_0_2"),
        F.col("notes").alias("manual_notes"),
    )


def eval_summary(scored: DataFrame) -> DataFrame:
    """Hit rates over all questions; recall over the answers with status 200 only."""
    total = F.count("*")
    columns = [total.alias("total"), ratio(F.sum("search_hit"), total).alias("search_hit_rate")]
    if "recall" in scored.columns:
        answered = F.col("ask_status") == OK_STATUS
        columns += [
            ratio(F.sum("ask_hit"), total).alias("ask_hit_rate"),
            ratio(
                F.sum(F.when(answered, F.col("recall"))), F.nullif(F.count_if(answered), F.lit(0))
            ).alias("avg_keyword_recall"),
        ]
    return scored.agg(*columns)
