import pytest
from pyspark.sql import functions as F

from citegrain.operators import answers, compare, quality, retrieval_eval
from citegrain.operators.compare import recommendation

SOURCE = "struct<doc_name string, chunk_id int, score double, text string>"


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(
        [
            (1, " why ", "a.txt", "x;Y;x", "n1"),
            (2, "how", "b.txt", "", ""),
            (3, "who", "c.txt", "z", ""),
            (4, "when", "a.txt", "x", ""),
        ],
        "qid long, query string, expected_doc string, expected_keywords string, notes string",
    )


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(
        [(1, 2, "b.txt", 0, 0.5, "two\nlines"), (1, 1, "a.txt", 4, 0.6, "one " * 30), (2, 1, "c.txt", 1, 0.9, "t")],
        "qid long, rank int, doc_name string, chunk_id int, score double, text string",
    )


def test_prompts(questions, hits):
    rows = {r.qid: r for r in answers.prompts(questions, hits, style=F.when(F.col("qid") == 1, " V2 ")).collect()}
    assert rows[1].prompt_style == "v2" and rows[2].prompt_style == "v1"
    assert rows[1].context == "[a.txt#chunk4] " + "one " * 30 + "\n\n[b.txt#chunk0] two\nlines"
    assert rows[1].prompt.startswith("你是一个严谨的RAG问答助手") and rows[3].context == ""
    assert "问题： why \n\n上下文：\n[a.txt#chunk4]" in rows[1].prompt
    assert rows[2].prompt.endswith("请输出：\n1) 简明答案\n2) 来源标签列表")


def test_braces_in_a_question_stay(spark, hits):
    asked = spark.createDataFrame([(1, "what is {context}?")], "qid long, query string")
    row = answers.prompts(asked, hits).first()
    assert "问题：what is {context}?\n" in row.prompt


def test_answer_records(questions, hits):
    rows = {r.qid: r for r in answers.answer_records(questions, hits, max_chars=9).collect()}
    one = rows[1]
    assert one.answer.split("\n")[1] == "基于检索片段的示例回答: " + ("one " * 30)[:80] + "；two lines"
    assert one.answer.startswith("[echo-rag:v1] 问题:  why \n")
    assert (one.confidence, one.grounded, one.citations) == ("medium", True, ["a.txt#chunk4", "b.txt#chunk0"])
    assert [tuple(s) for s in one.sources] == [("a.txt", 4, 0.6, "one one o..."), ("b.txt", 0, 0.5, "two lines")]
    empty = rows[3]
    assert (empty.answer, empty.confidence, empty.grounded) == ("未检索到可用上下文，无法回答。", "low", False)
    assert empty.citations == [] and empty.sources == []


@pytest.fixture(scope="module")
def responses(spark):
    body = "answer string, confidence string, prompt_style string, citations array<string>, sources array<%s>" % SOURCE
    both = [("a.txt", 4, 0.6, "t"), ("b.txt", 0, 0.5, "t"), ("", 1, 0.1, "t")]
    return spark.createDataFrame(
        [
            (1, 200, 10.0, "", "has x\nonly", " HIGH ", "v1 ", [" a.txt#chunk4 ", "a.txt#chunk4", " "], both),
            (2, 200, 20.0, "", "  ", "sure", "v1", ["b.txt#chunk7"], both),
            (3, 400, 30.0, "bad", None, None, None, None, None),
            (4, 200, 40.5, "", None, None, None, None, None),
        ],
        "qid long, http_status int, latency_ms double, error string, " + body,
    )


def test_retrieval_detail_and_summary(questions, hits, responses):
    scored = retrieval_eval.scored_questions(questions, hits, responses)
    rows = {r.id: r for r in retrieval_eval.eval_detail(scored).collect()}
    assert (rows[1].search_docs, rows[1].search_hit_expected_doc, rows[1].ask_hit_expected_doc) == ("a.txt|b.txt", 1, 1)
    assert (rows[1].query, rows[1].keyword_recall, rows[1].answer_preview, rows[1].manual_notes) == ("why", 0.667, "has x only", "n1")
    assert (rows[2].search_hit_expected_doc, rows[2].ask_hit_expected_doc, rows[2].keyword_recall) == (0, 1, 0.0)
    assert (rows[3].search_docs, rows[3].ask_status, rows[3].keyword_recall) == ("", 400, 0.0)
    total = retrieval_eval.eval_summary(scored).first()
    # recall is over the three answers with status 200, the hit rates over all four questions
    assert tuple(total) == (4, 0.25, 0.5, pytest.approx((2 / 3) / 3))
    bare = retrieval_eval.scored_questions(questions, hits)
    assert retrieval_eval.eval_detail(bare).filter("id = 1").first().keyword_recall == ""
    assert tuple(retrieval_eval.eval_summary(bare).first()) == (4, 0.25)


def test_hit_at_k_never_falls_with_k(spark, questions, hits):
    rates = [
        retrieval_eval.eval_summary(
            retrieval_eval.scored_questions(questions, hits.filter(F.col("rank") <= k))
        ).first().search_hit_rate
        for k in (0, 1, 2)
    ]
    assert rates == sorted(rates)


def test_quality(questions, responses):
    detail = quality.quality_detail(questions, responses)
    rows = {r.id: r for r in quality.quality_rows(detail).collect()}
    one = rows[1]
    assert (one.format_ok, one.citation_compliant, one.expected_doc_cited) == (1, 1, 1)
    assert (one.citations, one.source_labels) == ("a.txt#chunk4", "a.txt#chunk4|b.txt#chunk0")
    assert (one.confidence, one.prompt_style_resp, one.keyword_recall) == ("high", "v1", 0.667)
    assert (rows[2].format_ok, rows[2].citation_compliant, rows[2].expected_doc_cited) == (0, 0, 1)
    assert tuple(rows[3])[3:] == (400, 30.0, 0, 0, 0, 0.0, "", "", "", "", "", "bad")
    assert (rows[4].http_status, rows[4].format_ok) == (200, 0)
    total = quality.quality_summary(detail).first()
    assert tuple(total) == (4, 0.5, 0.25, 0.25, 0.5, 0.1667, 25.125)
    assert quality.quality_summary(detail, ["prompt_style_resp"]).count() == 2


# recalls of the ten questions in two runs; only the fifth changed
BASELINE = [0.667, 1, 1, 1, 1, 1, 1, 1, 1, 0]
CANDIDATE = [0.667, 1, 1, 1, 0.5, 1, 1, 1, 1, 0]


def run(spark, recalls, extra=()):
    rows = [(str(i + 1), f"q{i + 1}", "1", "1", f"{r:.3f}", "d", i) for i, r in enumerate(recalls)]
    return spark.createDataFrame(
        [*rows, *extra],
        "id string, query string, search_hit_expected_doc string, ask_hit_expected_doc string, "
        "keyword_recall string, ask_source_docs string, seq int",
    )


def test_golden_comparison(spark):
    base, cand = run(spark, BASELINE), run(spark, CANDIDATE)
    deltas = compare.paired_deltas(base, cand, "seq")
    assert [r.id for r in deltas.collect()] == [str(i) for i in range(1, 11)]
    assert tuple(compare.change_counts(deltas).first()) == (0, 1, 9)
    worse = compare.with_change(deltas, "regressed").collect()
    assert [(r.id, r.baseline_kw, r.candidate_kw, r.delta_kw) for r in worse] == [("5", 1.0, 0.5, -0.5)]
    table = compare.metric_table(compare.run_aggregate(base), compare.run_aggregate(cand)).collect()
    shown = [(r.metric, round(r.baseline, 3), round(r.candidate, 3), round(r.delta, 3)) for r in table]
    assert shown == [
        ("search_hit_rate", 1.0, 1.0, 0.0),
        ("ask_hit_rate", 1.0, 1.0, 0.0),
        ("avg_keyword_recall", 0.867, 0.817, -0.05),
    ]


def test_duplicates_blanks_and_one_sided_ids(spark):
    extra = [("5", "again", "x", "", "1.0", "e", 50), (" ", "blank", "1", "1", "1", "", 51), (" 2 ", "late", "0", "0", "oops", "", 52), ("99", "new", "0", "0", "1", "", 53)]
    cand = run(spark, CANDIDATE, extra)
    kept = {r.id: r for r in compare.last_per_id(cand, "seq").collect()}
    assert len(kept) == 11 and kept["5"].query == "again" and kept["2"].keyword_recall == "oops"
    changes = {r.id: r.change for r in compare.paired_deltas(run(spark, BASELINE), cand, "seq").collect()}
    assert len(changes) == 10 and changes["5"] == "unchanged" and changes["2"] == "regressed"
    raw = compare.run_aggregate(cand).first()
    assert raw.total == 14.0 and raw.search_hit_rate == pytest.approx(11 / 14)
    assert raw.avg_keyword_recall == pytest.approx((sum(CANDIDATE) + 3) / 14)


@pytest.mark.parametrize(
    "change, word",
    [
        ({"http_success_rate": 0.8, "format_ok_rate": 0.0}, "HTTP success"),
        ({"format_ok_rate": 0.8}, "format compliance"),
        ({"citation_compliance_rate": 0.0, "avg_keyword_recall": 1.0}, "citation compliance"),
        ({"avg_keyword_recall": 0.5}, "Keep candidate"),
        ({"avg_keyword_recall": 0.4}, "review detail CSV"),
    ],
)
def test_gate(spark, change, word):
    base = dict.fromkeys(compare.QUALITY_METRICS, 0.9) | {"avg_keyword_recall": 0.5}
    names = list(base)
    schema = ", ".join(f"{n} double" for n in names)
    one = lambda d: spark.createDataFrame([tuple(float(d[n]) for n in names)], schema)
    table = compare.metric_table(one(base), one(base | change), compare.QUALITY_METRICS)
    assert word in recommendation(table).first()[0]


def test_missing_metric_counts_as_zero(spark):
    one = spark.createDataFrame([(0.5,)], "avg_keyword_recall double")
    table = compare.metric_table(one, one, compare.QUALITY_METRICS)
    assert {r.metric: r.baseline for r in table.collect()}["format_ok_rate"] == 0.0
