"""Tool planning, traces and tool-use evaluation over the texts of `documents` and `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.catalog.retrieval_queries import SQL_LEXICAL_SCORES
from citegrain.catalog.views import SQL_STRIP_CHARS, corpus, request_log, table, with_views
from citegrain.operators import tools
from citegrain.plans.workdir import written


def tool_queries(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("qid"), F.col("text").alias("query"),
        F.col("doc_id").alias("number"),
    )
    turns = table(s, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("query"),
        F.col("conv_id").alias("number"),
    )
    return docs.unionByName(turns)


def _steps(s: SparkSession, d: str) -> DataFrame:
    return tools.step_rows(tools.plan_tool_calls(tool_queries(s, d).drop("number")))


def _shown_steps(s: SparkSession, d: str) -> DataFrame:
    return _steps(s, d).select(
        "qid",
        "step",
        "tool",
        "reason",
        F.md5(
            F.coalesce(
                F.try_variant_get("args", "$.expression", "string"),
                F.try_variant_get("args", "$.query", "string"),
            )
        ).alias("argument_md5"),
        F.coalesce(F.try_variant_get("args", "$.top_k", "int"), F.lit(0)).alias("top_k"),
    )


def _calculated(steps: DataFrame) -> DataFrame:
    """The supplied calculator results: a short plain sum or difference is right, all else fails."""
    whole = F.try_variant_get("args", "$.expression", "string")
    sum_ = r"^([0-9]{1,9})\s*([-+])\s*([0-9]{1,9})$"
    a, op, b = (F.regexp_extract("expression", sum_, i) for i in (1, 2, 3))
    left, right = a.try_cast("bigint"), b.try_cast("bigint")
    value = F.when(op == "+", left + right).otherwise(left - right)
    good = F.to_variant_object(F.struct(F.lit(True).alias("ok"), value.alias("value")))
    bad = F.to_variant_object(F.struct(F.lit(False).alias("ok"), F.lit("not a plain sum").alias("error")))
    return (
        steps.filter(F.col("tool") == tools.CALCULATOR)
        .select("qid", "step", whole.alias("expression"))
        .select("qid", "step", F.when(F.col("expression").rlike(sum_), good).otherwise(bad).alias("result"))
    )


def _answers(s: SparkSession, d: str) -> DataFrame:
    # planned once: the texts are long, and three things read the few steps
    steps = written(_steps(s, d))
    results = tools.search_results(steps, corpus(s, d)).unionByName(_calculated(steps))
    return tools.roll_up(tool_queries(s, d).select("qid", "query"), tools.with_results(steps, results))


#: Characters of a query that the second search of `TWO_SEARCHES` asks for.
HEAD = 60
TWO_SEARCHES = (
    *tools.RULES[1:],
    tools.Rule(
        tools.SEARCH_DOCS, tools.needs_search, lambda q: F.struct(F.substring(q, 1, HEAD).alias("query")), "query head"
    ),
)


def _two_searches(s: SparkSession, d: str) -> DataFrame:
    """Two searches for one query: its whole text, then its head; each step has its own hits."""
    asked = tool_queries(s, d).drop("number")
    steps = written(tools.step_rows(tools.plan_tool_calls(asked, TWO_SEARCHES)))
    trace = tools.with_results(steps, tools.search_results(steps, corpus(s, d)))
    return tools.roll_up(asked.select("qid"), trace).select("qid", F.array_join("used_tools", "|").alias("used_tools"), "final_answer")


def _tool_detail(s: SparkSession, d: str) -> DataFrame:
    """Expected tools follow the label of the document's or conversation's number, status and latency its
    event; what has no label expects no tool, and what has no event is a failure."""
    labels = table(s, d, "labels").select(
        F.col("doc_id").alias("number"),
        F.when(F.col("toxic") == 1, " calculator | search_docs ").when(F.col("quality") == 1, "search_docs").alias("expected_tools"),
    )
    asked = tool_queries(s, d)
    questions = asked.join(labels, "number", "left").withColumns(
        {"expected_tools": F.coalesce("expected_tools", F.lit("")), "expected_keywords": F.lit("score=3; result ;")}
    )
    served = request_log(s, d).select(
        F.col("event_id").alias("number"), F.col("status_code").alias("http_status"), "latency_ms", "error"
    )
    return tools.tool_eval_detail(questions, _answers(s, d).join(asked.select("qid", "number"), "qid").join(served, "number", "left"))


QUERIES = {
    "j1_j2_j3_intents": lambda s, d: tool_queries(s, d).select(
        "qid",
        tools.needs_math(F.col("query")).cast("int").alias("needs_math"),
        tools.needs_search(F.col("query")).cast("int").alias("needs_search"),
        F.md5(tools.extract_expression(F.col("query"))).alias("expression_md5"),
    ),
    "j4_planned_steps": _shown_steps,
    "j4_one_step_plan": lambda s, d: tools.step_rows(
        tools.plan_tool_calls(tools.checked_requests(tool_queries(s, d).drop("number"), 1), max_steps=1)
    ).groupBy("tool", "step").agg(F.count("*").alias("n")),
    "j5_trace_answers": lambda s, d: _answers(s, d).select(
        "qid", F.array_join("used_tools", "|").alias("used_tools"), "final_answer"
    ),
    "j5_two_searches": _two_searches,
    "j6_j7_j8_tool_detail": _tool_detail,
    "j9_tool_summary": lambda s, d: tools.tool_eval_summary(written(_tool_detail(s, d))),
}

_QUERIES = """
    SELECT 'd' || doc_id AS qid, text AS query, doc_id AS number FROM documents
    UNION ALL SELECT 'c' || conv_id || '-' || turn, text, conv_id FROM conversations"""


def _words(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_INTENTS = f"""
    SELECT qid, query,
      ({_words('query', tools.MATH_KEYWORDS)} OR regexp_matches(query, '\\d+\\s*[-+/*]\\s*\\d+')) AS math,
      {_words('lower(query)', tools.SEARCH_KEYWORDS)} AS search,
      CASE WHEN regexp_matches(first, '[0-9]') THEN first ELSE whole END AS expression
    FROM (SELECT *, trim(regexp_extract(whole, '[-+/*()0-9.\\s]+'), {SQL_STRIP_CHARS}) AS first
          FROM (SELECT *, trim(query, {SQL_STRIP_CHARS}) AS whole FROM tool_queries))"""

_STEPS = f"""
    SELECT qid, 1 AS step, 'calculator' AS tool, '{tools.MATH_REASON}' AS reason, expression AS argument, 0 AS top_k
    FROM intents WHERE math
    UNION ALL
    SELECT qid, CASE WHEN math THEN 2 ELSE 1 END, 'search_docs', '{tools.SEARCH_REASON}', query, 2
    FROM intents WHERE search"""

_SUM = "'^([0-9]{1,9})\\s*([-+])\\s*([0-9]{1,9})$'"
_TOLD = f"""
    SELECT qid, step, tool, CASE WHEN regexp_matches(argument, {_SUM}) THEN 'calculation result: ' ||
        (TRY_CAST(regexp_extract(argument, {_SUM}, 1) AS BIGINT)
          + (CASE regexp_extract(argument, {_SUM}, 2) WHEN '+' THEN 1 ELSE -1 END)
            * TRY_CAST(regexp_extract(argument, {_SUM}, 3) AS BIGINT))
      ELSE 'calculator failed: not a plain sum' END AS said
    FROM steps WHERE tool = 'calculator'
    UNION ALL
    SELECT s.qid, s.step, s.tool, 'top docs: ' || string_agg(doc_name || ' (score=' || score || ')', ', ' ORDER BY rank)
    FROM steps s JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_name) AS rank
                       FROM ({SQL_LEXICAL_SCORES})) h ON h.qid = s.qid AND h.rank <= 2
    WHERE s.tool = 'search_docs' GROUP BY s.qid, s.step, s.tool"""

_ANSWERS = f"""
    SELECT q.qid, q.query, q.number, coalesce(t.used, '') AS used_tools, coalesce(t.said, '{tools.NO_TOOL_ANSWER}') AS final_answer
    FROM tool_queries q LEFT JOIN (
      SELECT qid, string_agg(tool, '|' ORDER BY step) AS used, string_agg(said, '{tools.SUMMARY_JOIN}' ORDER BY step) AS said
      FROM told GROUP BY qid) t ON t.qid = q.qid"""

_DETAIL = f"""
    SELECT a.qid AS id, trim(a.query, {SQL_STRIP_CHARS}) AS query,
      CASE WHEN toxic = 1 THEN 'calculator|search_docs' WHEN quality = 1 THEN 'search_docs' ELSE '' END AS expected_tools,
      CASE WHEN ok THEN a.used_tools ELSE '' END AS used_tools,
      CAST(ok AND CASE WHEN toxic = 1 THEN a.used_tools = 'calculator|search_docs'
        WHEN quality = 1 THEN contains(a.used_tools, 'search_docs') ELSE false END AS INT) AS tool_match,
      CAST(ok AND (contains(a.final_answer, 'score=3') OR contains(a.final_answer, 'result')) AS INT) AS keyword_hit,
      CAST(coalesce(status_code, 0) AS BIGINT) AS http_status, round(coalesce(latency_ms, 0), 3) AS latency_ms,
      CASE WHEN ok THEN substr(replace(a.final_answer, chr(10), ' '), 1, 220) ELSE '' END AS final_answer,
      coalesce(error, '') AS error
    FROM (SELECT a.*, r.status_code, r.latency_ms, r.error, coalesce(r.status_code = 200, false) AS ok
          FROM answers a LEFT JOIN request_log r ON r.event_id = a.number) a
    LEFT JOIN labels l ON l.doc_id = a.number"""

_VIEWS = {
    "tool_queries": _QUERIES,
    "intents": _INTENTS,
    "steps": _STEPS,
    "asked": "SELECT qid, argument AS query FROM steps WHERE tool = 'search_docs'",
    "told": _TOLD,
    "answers": _ANSWERS,
    "detail": _DETAIL,
}


def _over(sql: str) -> str:
    return with_views(sql, "corpus", "request_log", **_VIEWS)


SQL = {
    "j1_j2_j3_intents": _over(
        """SELECT qid, CAST(math AS INT) AS needs_math, CAST(search AS INT) AS needs_search,
             md5(expression) AS expression_md5 FROM intents"""
    ),
    "j4_planned_steps": _over(
        "SELECT qid, step, tool, reason, md5(argument) AS argument_md5, top_k FROM steps"
    ),
    "j4_one_step_plan": _over(
        "SELECT tool, step, count(*) AS n FROM steps WHERE step <= 1 GROUP BY tool, step"
    ),
    "j5_trace_answers": _over("SELECT qid, used_tools, final_answer FROM answers"),
    "j5_two_searches": with_views(
        f"""SELECT q.qid, coalesce(string_agg(CASE WHEN step > 0 THEN 'search_docs' END, '|' ORDER BY step), '') AS used_tools,
              coalesce(string_agg(said, '{tools.SUMMARY_JOIN}' ORDER BY step), '{tools.NO_TOOL_ANSWER}') AS final_answer
            FROM tool_queries q LEFT JOIN (
              SELECT CAST(substr(qid, 3) AS VARCHAR) AS qid, CAST(left(qid, 1) AS INT) AS step,
                'top docs: ' || string_agg(doc_name || ' (score=' || score || ')', ', ' ORDER BY rank) AS said
              FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_name) AS rank FROM ({SQL_LEXICAL_SCORES}))
              WHERE rank <= 2 GROUP BY qid) t USING (qid)
            GROUP BY q.qid""",
        "corpus", "request_log",
        **{n: _VIEWS[n] for n in ("tool_queries", "intents")},
        asked=f"""SELECT '1 ' || qid AS qid, query FROM intents WHERE search
            UNION ALL SELECT '2 ' || qid, substr(query, 1, {HEAD}) FROM intents WHERE search""",
    ),
    "j6_j7_j8_tool_detail": _over("SELECT * FROM detail"),
    "j9_tool_summary": _over(
        """SELECT count(*) AS total, round(avg(CAST(http_status = 200 AS INT)), 4) AS http_success_rate,
             round(avg(tool_match), 4) AS tool_match_rate, round(avg(keyword_hit), 4) AS keyword_hit_rate,
             round(avg(latency_ms), 3) AS avg_latency_ms FROM detail"""
    ),
}
