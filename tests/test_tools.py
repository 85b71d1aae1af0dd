import pytest
from pyspark.sql import functions as F

from citegrain.operators import tools

TEXTS = [
    "请计算 6 * (2 + 5)",
    "what does a fragment hold",
    "Please add 2+2",
    "  12/4",
    "算一下 RAG 的流程 3 - 1",
    "hello there",
    "phone 555-1234 FastAPI",
    "- no digits (just) -",
]


@pytest.fixture(scope="module")
def planned(spark):
    queries = spark.createDataFrame(list(enumerate(TEXTS)), "qid long, query string")
    return queries, tools.plan_tool_calls(queries)


def test_plan(planned):
    _, plan = planned
    got = {r.qid: [(s.step, s.tool) for s in r.steps] for r in plan.collect()}
    calc, search = tools.CALCULATOR, tools.SEARCH_DOCS
    assert got == {
        0: [(1, calc)],
        1: [(1, search)],
        2: [(1, calc)],
        3: [(1, calc)],
        4: [(1, calc), (2, search)],
        5: [],
        6: [(1, calc), (2, search)],
        7: [],
    }


def test_expressions(planned):
    queries, _ = planned
    rows = queries.select("qid", tools.extract_expression(F.col("query")).alias("e")).collect()
    got = {r.qid: r.e for r in rows}
    # an early lone blank is the first run and holds no digit, so the whole text stays
    assert got[0] == "6 * (2 + 5)"
    assert got[2] == "Please add 2+2" and got[3] == "12/4" and got[7] == "- no digits (just) -"


def test_step_bounds(planned):
    queries, _ = planned
    for most, steps in ((0, 1), (1, 1), (2, 2)):
        plan = tools.plan_tool_calls(queries, max_steps=most)
        assert plan.filter("qid = 4").select(F.size("steps")).first()[0] == steps
    with pytest.raises(ValueError):
        tools.checked_requests(queries, 9)


def test_own_rule(planned):
    queries, _ = planned
    rule = tools.Rule("greet", lambda q: q.startswith("hello"), lambda q: F.struct(q.alias("to")), "polite")
    rows = tools.step_rows(tools.plan_tool_calls(queries, (*tools.RULES, rule))).filter("tool = 'greet'")
    assert [(r.qid, r.step, r.reason) for r in rows.collect()] == [(5, 1, "polite")]


def test_trace_and_answers(spark, planned):
    queries, plan = planned
    docs = spark.createDataFrame(
        [("a.txt", "fragment of rag"), ("b.txt", "fastapi phone"), ("c.txt", "")], "doc_name string, text string"
    )
    steps = tools.step_rows(plan)
    numbers = spark.createDataFrame(
        [(0, 1, '{"ok": true, "value": "42.0"}'), (2, 1, '{"ok": false, "error": "invalid expression"}'), (3, 1, '{"ok": false}')],
        "qid long, step int, r string",
    ).select("qid", "step", F.parse_json("r").alias("result"))
    results = tools.search_results(steps, docs).unionByName(numbers)
    rows = {r.qid: r for r in tools.roll_up(queries, tools.with_results(steps, results)).collect()}
    assert rows[0].final_answer == "calculation result: 42.0"
    assert rows[1].final_answer == "top docs: a.txt (score=1), b.txt (score=0)"
    assert rows[2].final_answer == "calculator failed: invalid expression"
    assert rows[3].final_answer == "calculator failed: unknown error"
    assert rows[4].used_tools == ["calculator", "search_docs"]
    assert rows[4].final_answer == (
        "calculator failed: tool not found: calculator；top docs: a.txt (score=1), b.txt (score=0)"
    )
    assert rows[6].final_answer.endswith("top docs: b.txt (score=2), a.txt (score=0)")
    assert rows[5].used_tools == [] and rows[5].final_answer == tools.NO_TOOL_ANSWER


def test_step_sentences(spark):
    rows = spark.createDataFrame(
        [("search_docs", '{"ok": true, "hits": []}'), ("greet", '{"ok": true}'), ("greet", '{"ok": false, "error": "e"}')],
        "tool string, r string",
    )
    said = rows.select(tools.step_summary(F.col("tool"), F.parse_json("r"))).collect()
    assert [r[0] for r in said] == ["no matching docs found", "greet executed", "greet failed: e"]


def test_tool_eval(spark):
    questions = spark.createDataFrame(
        [(1, " q ", "b | a", "230;x"), (2, "q", "", "y"), (3, "q", "a", ""), (4, "q", "a", "z")],
        "qid long, query string, expected_tools string, expected_keywords string",
    )
    responses = spark.createDataFrame(
        [(1, 200, 1.23456, "", ["a", "b", "a"], "is 230\nyes"), (2, 200, 2.0, "", ["a"], "n"), (3, 200, 3.0, "", ["a"], "z"), (4, 500, 4.0, "down", None, None)],
        "qid long, http_status int, latency_ms double, error string, used_tools array<string>, final_answer string",
    )
    detail = tools.tool_eval_detail(questions, responses)
    rows = {r.id: r for r in detail.collect()}
    assert tuple(rows[1])[1:] == ("q", "a|b", "a|b", 1, 1, 200, 1.235, "is 230 yes", "")
    assert [(rows[i].tool_match, rows[i].keyword_hit) for i in (2, 3, 4)] == [(0, 0), (1, 0), (0, 0)]
    assert tuple(rows[4])[3:] == ("", 0, 0, 500, 4.0, "", "down")
    assert tuple(tools.tool_eval_summary(detail).first()) == (4, 0.75, 0.5, 0.25, 2.559)


def test_two_searches_of_one_query_keep_their_own_hits(spark):
    rules = [
        tools.Rule(tools.SEARCH_DOCS, tools.needs_search, lambda q, w=w: F.struct(F.lit(w).alias("query")), w) for w in ("phone", "rag")
    ]
    queries = spark.createDataFrame([(1, "rag?"), (2, "about fastapi")], "qid long, query string")
    docs = spark.createDataFrame([("a.txt", "fragment of rag"), ("b.txt", "fastapi phone"), ("c.txt", "")], "doc_name string, text string")
    steps = tools.step_rows(tools.plan_tool_calls(queries, rules))
    found = {
        (r.qid, r.step): r.top
        for r in tools.search_results(steps, docs).select("qid", "step", F.try_variant_get("result", "$.hits[0].doc_name", "string").alias("top")).collect()
    }
    assert found == {(1, 1): "b.txt", (1, 2): "a.txt", (2, 1): "b.txt", (2, 2): "a.txt"}
