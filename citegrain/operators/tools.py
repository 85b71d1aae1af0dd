"""Rule-based tool planning, trace roll-up and tool-use evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import hard_preview, split_list, split_set, strip
from citegrain.functions.values import any_keyword, flag, non_empty_subset, ratio
from citegrain.operators.lexical import TOP_DOCS, search_documents

# Intent keywords and patterns, reasons, answer texts and bounds.
MATH_KEYWORDS = ("计算", "算一下", "加", "减", "乘", "除", "平方", "表达式")
SEARCH_KEYWORDS = ("rag", "fastapi", "ai engineer", "ai工程师", "检索", "文档", "流程", "能力")
ARITHMETIC_PATTERN = r"(?U)\d+\s*[-+/*]\s*\d+"
EXPRESSION_PATTERN = r"(?U)[-+/*()0-9.\s]+"
CALCULATOR, SEARCH_DOCS = "calculator", "search_docs"
MATH_REASON = "query contains arithmetic intent"
SEARCH_REASON = "query asks domain knowledge"
NO_TOOL_ANSWER = "未触发任何工具。请明确你是要计算问题，还是查询 RAG/FastAPI/AI 工程师相关知识。"
NO_DOCS_ANSWER = "no matching docs found"
UNKNOWN_ERROR = "unknown error"
SUMMARY_JOIN = "；"
DEFAULT_MAX_STEPS = 4
MAX_STEPS = 8
OK_STATUS = 200
ANSWER_CHARS = 220


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def needs_math(query: Column, keywords: Sequence[str] = MATH_KEYWORDS) -> Column:
    return _holds_any(query, keywords) | query.rlike(ARITHMETIC_PATTERN)


def needs_search(query: Column, keywords: Sequence[str] = SEARCH_KEYWORDS) -> Column:
    return _holds_any(F.lower(query), keywords)


def extract_expression(query: Column) -> Column:
    """The first run of operators, digits, dots and blanks if it holds a digit, else the query.

    Only the first run is looked at, so an early lone blank means the whole stripped text.
    """
    text = strip(query)
    first = strip(F.regexp_extract(text, EXPRESSION_PATTERN, 0))
    return F.when(first.rlike("[0-9]"), first).otherwise(text)


@dataclass(frozen=True)
class Rule:
    """When a tool is called, with which arguments, and why; columns are made from the query."""

    tool: str
    applies: Callable[[Column], Column]
    arguments: Callable[[Column], Column]
    reason: str


RULES = (
    Rule(
        CALCULATOR,
        needs_math,
        lambda q: F.struct(extract_expression(q).alias("expression")),
        MATH_REASON,
    ),
    Rule(
        SEARCH_DOCS,
        needs_search,
        lambda q: F.struct(q.alias("query"), F.lit(TOP_DOCS).alias("top_k")),
        SEARCH_REASON,
    ),
)


def plan_tool_calls(
    queries: DataFrame,
    rules: Sequence[Rule] = RULES,
    max_steps: int = DEFAULT_MAX_STEPS,
    query: str = "query",
) -> DataFrame:
    """Adds ``steps``: the tools to call in rule order, numbered from 1, at most *max_steps*."""
    text = F.col(query)
    calls = [
        F.when(
            rule.applies(text),
            F.struct(
                F.lit(rule.tool).alias("tool"),
                F.lit(rule.reason).alias("reason"),
                F.to_variant_object(rule.arguments(text)).alias("args"),
            ),
        )
        for rule in rules
    ]
    wanted = F.slice(F.filter(F.array(*calls), lambda c: c.isNotNull()), 1, max(1, max_steps))
    numbered = F.transform(
        wanted,
        lambda c, i: F.struct(
            (i + 1).alias("step"), c["tool"].alias("tool"), c["reason"].alias("reason"), c["args"].alias("args")
        ),
    )
    return queries.withColumn("steps", numbered)


def checked_requests(queries: DataFrame, max_steps: int, query: str = "query") -> DataFrame:
    """Request bounds: max_steps in 1..8, empty queries are left out."""
    if not 1 <= max_steps <= MAX_STEPS:
        raise ValueError(f"max_steps must be in 1..{MAX_STEPS}")
    return queries.filter(F.length(query) >= 1)


def step_rows(planned: DataFrame, key: str = "qid") -> DataFrame:
    """One row per planned step: key, step, tool, reason, args."""
    return planned.select(key, F.explode("steps").alias("s")).select(key, "s.*")


def search_results(
    steps: DataFrame, documents: DataFrame, key: str = "qid", **search: int
) -> DataFrame:
    """Results ``(key, step, result)`` of the document-search steps, each searched for itself."""
    asked = steps.filter(F.col("tool") == SEARCH_DOCS).select(
        key,
        "step",
        F.concat_ws(" ", F.col("step").cast("string"), F.col(key).cast("string")).alias("asked"),
        F.try_variant_get("args", "$.query", "string").alias("query"),
    )
    hits = search_documents(asked, documents, TOP_DOCS, "asked", **search)
    per_step = hits.groupBy("asked").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "doc_name", "score", "snippet"))),
            lambda h: F.struct(
                h["doc_name"].alias("doc_name"), h["score"].alias("score"), h["snippet"].alias("snippet")
            ),
        ).alias("hits")
    )
    found = F.to_variant_object(F.struct(F.lit(True).alias("ok"), "query", "hits"))
    empty = F.to_variant_object(
        F.struct(F.lit(False).alias("ok"), F.lit("No docs found").alias("error"))
    )
    return asked.join(per_step, "asked", "left").select(
        key, "step", F.when(F.col("hits").isNotNull(), found).otherwise(empty).alias("result")
    )


def with_results(steps: DataFrame, results: DataFrame, key: str = "qid") -> DataFrame:
    """The trace: every step with its result; a step without one counts as a missing tool."""
    missing = F.to_variant_object(
        F.struct(
            F.lit(False).alias("ok"),
            F.concat(F.lit("tool not found: "), "tool").alias("error"),
        )
    )
    return steps.join(results, [key, "step"], "left").withColumn(
        "result", F.coalesce("result", missing)
    )


def step_summary(tool: Column, result: Column) -> Column:
    """One sentence on a step's result."""

    def got(path: str, kind: str) -> Column:
        return F.try_variant_get(result, path, kind)

    hits = got("$.hits", "array<struct<doc_name string, score string>>")
    lines = F.transform(
        hits, lambda h: F.concat(h["doc_name"], F.lit(" (score="), h["score"], F.lit(")"))
    )
    error = F.coalesce(got("$.error", "string"), F.lit(UNKNOWN_ERROR))
    return (
        F.when(
            ~F.coalesce(got("$.ok", "boolean"), F.lit(False)),
            F.concat(tool, F.lit(" failed: "), error),
        )
        .when(
            tool == CALCULATOR,
            F.concat(F.lit("calculation result: "), F.coalesce(got("$.value", "string"), F.lit("None"))),
        )
        .when((tool == SEARCH_DOCS) & (F.coalesce(F.size(hits), F.lit(0)) < 1), NO_DOCS_ANSWER)
        .when(tool == SEARCH_DOCS, F.concat(F.lit("top docs: "), F.array_join(lines, ", ")))
        .otherwise(F.concat(tool, F.lit(" executed")))
    )


def roll_up(queries: DataFrame, trace: DataFrame, key: str = "qid") -> DataFrame:
    """Adds ``used_tools`` and ``final_answer`` to each query from its trace, in step order.

    A query has at most 8 steps, so its steps fit one row.
    """
    told = trace.select(key, "step", "tool", step_summary(F.col("tool"), F.col("result")).alias("said"))
    ordered = F.array_sort(F.collect_list(F.struct("step", "tool", "said")))
    rolled = told.groupBy(key).agg(ordered.alias("trace")).select(
        key,
        F.transform("trace", lambda t: t["tool"]).alias("used_tools"),
        F.array_join(F.transform("trace", lambda t: t["said"]), SUMMARY_JOIN).alias("final_answer"),
    )
    return queries.join(rolled, key, "left").withColumns(
        {
            "used_tools": F.coalesce("used_tools", F.array().cast("array<string>")),
            "final_answer": F.coalesce("final_answer", F.lit(NO_TOOL_ANSWER)),
        }
    )


def tool_eval_detail(questions: DataFrame, responses: DataFrame, key: str = "qid") -> DataFrame:
    """One scored row per question.

    *questions*: key, query, expected_tools (``|``-separated), expected_keywords; *responses*:
    key, http_status, latency_ms, error, used_tools, final_answer.
    """
    asked = questions.select(
        key,
        strip("query").alias("query"),
        F.array_sort(split_set("expected_tools")).alias("expected"),
        split_list("expected_keywords").alias("keywords"),
    )
    told = responses.select(key, "http_status", "latency_ms", "error", "used_tools", "final_answer")
    rows = asked.join(told, key, "left")
    ok = F.coalesce(F.col("http_status") == OK_STATUS, F.lit(False))
    used = F.when(ok, F.array_sort(F.array_distinct("used_tools")))
    used = F.coalesce(used, F.array().cast("array<string>"))
    answer = F.when(ok, F.col("final_answer")).otherwise(F.lit(""))
    return rows.withColumns({"used": used, "said": F.coalesce(answer, F.lit(""))}).select(
        F.col(key).alias("id"),
        "query",
        F.array_join("expected", "|").alias("expected_tools"),
        F.array_join("used", "|").alias("used_tools"),
        flag(non_empty_subset(F.col("expected"), F.col("used"))).alias("tool_match"),
        flag(any_keyword("said", "keywords")).alias("keyword_hit"),
        F.coalesce("http_status", F.lit(0)).alias("http_status"),
        F.round(F.coalesce("latency_ms", F.lit(0.0)), 3).alias("latency_ms"),
        hard_preview("said", ANSWER_CHARS).alias("final_answer"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def tool_eval_summary(detail: DataFrame) -> DataFrame:
    total = F.count("*")
    return detail.agg(
        total.alias("total"),
        F.round(ratio(F.count_if(F.col("http_status") == OK_STATUS), total), 4).alias("http_success_rate"),
        F.round(ratio(F.sum("tool_match"), total), 4).alias("tool_match_rate"),
        F.round(ratio(F.sum("keyword_hit"), total), 4).alias("keyword_hit_rate"),
        F.round(ratio(F.sum("latency_ms"), total), 3).alias("avg_latency_ms"),
    )
