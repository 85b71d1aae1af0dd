"""Token-overlap document search.

A document scores one point for every query token, repeats included, that its text
contains. Joining tokens to tokens would put out one row per question and document sharing
any common word, nearly all pairs; the search of `plans.postings` passes over the documents that cannot be among the
best and scores the others inside a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import hard_preview, strip, tokens
from citegrain.plans.block_topk import MAX_BROADCAST_QUESTIONS
from citegrain.plans.postings import build_index, top_overlaps

# Default result size and snippet length.
TOP_DOCS = 2
SNIPPET_CHARS = 180


def document_index(documents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The inverted index of the documents' tokens, written; with name, snippet and the columns in *carry*."""
    bags = documents.select(
        "doc_name",
        F.coalesce(F.array_distinct(tokens("text")), F.array().cast("array<string>")).alias("tokens"),
        F.coalesce(hard_preview(strip("text"), SNIPPET_CHARS), F.lit("")).alias("snippet"),
        *carry,
    )
    return build_index(bags, "tokens", ["doc_name", "snippet", *carry])


def asked_tokens(questions: DataFrame, key: str = "qid", query: str = "query") -> DataFrame:
    return questions.select(key, F.coalesce(tokens(query), F.array().cast("array<string>")).alias("tokens"))


def search_index(
    questions: DataFrame,
    index: DataFrame,
    top_k: int = TOP_DOCS,
    key: str = "qid",
    query: str = "query",
    max_broadcast: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """`search_documents` over a kept index."""
    hits = top_overlaps(
        asked_tokens(questions, key, query), index, max(1, top_k), key, "tokens", ("doc_name",), max_broadcast
    )
    return hits.withColumn("score", F.col("score").cast("bigint"))


def search_documents(
    questions: DataFrame,
    documents: DataFrame,
    top_k: int = TOP_DOCS,
    key: str = "qid",
    query: str = "query",
    carry: Sequence[str] = (),
    max_broadcast: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """The best documents of every question: score falling, then document name.

    Documents without any common token are eligible, with score 0; an empty corpus gives no
    rows. A *top_k* below 1 counts as 1. ``snippet`` is the head of the stripped text. A NULL text
    or query has no tokens.
    """
    return search_index(questions, document_index(documents, carry), top_k, key, query, max_broadcast)
