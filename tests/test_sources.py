import json
import math

import pytest
from pyspark.sql import functions as F

from citegrain.operators import logs, reuse
from citegrain.operators.compare import last_per_id
from citegrain.sources import documents as files
from citegrain.sources import request_log as log_files
from citegrain.sources.responses import parse_responses


def test_text_documents(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("一\r\n\r\n二\rthree".encode())
    (tmp_path / "a.txt").write_bytes(b"x")
    (tmp_path / "c.md").write_bytes(b"no")
    rows = files.read_text_documents(spark, str(tmp_path)).orderBy("doc_name").collect()
    assert [tuple(r) for r in rows] == [("a.txt", "x"), ("b.txt", "一\n\n二\nthree")]


def test_labelled_set(spark, tmp_path):
    path = tmp_path / "set.csv"
    path.write_bytes('﻿id,query,notes\n1,"two\nlines, ""quoted""",\n2,,x\n'.encode())
    want = [("1", 'two\nlines, "quoted"', ""), ("2", "", "x")]
    assert [tuple(r) for r in files.read_labelled_set(spark, str(path)).orderBy("id").collect()] == want
    named = files.read_labelled_set(spark, str(path), ["id", "query", "notes"]).orderBy("id")
    assert [tuple(r) for r in named.collect()] == want


def test_summary_and_detail(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"total": 3, "tag": "中"}, indent=2, ensure_ascii=False))
    assert files.read_summary(spark, str(tmp_path / "s.json")).first().asDict() == {"total": 3, "tag": "中"}
    row = spark.range(1).select(F.lit("a|b").alias("x"), F.array(F.lit("p"), F.lit("q")).alias("docs"))
    files.write_detail(row, str(tmp_path / "d"))
    assert tuple(files.read_labelled_set(spark, str(tmp_path / "d")).first()) == ("a|b", "p|q")
    files.write_summary(row.select("x"), str(tmp_path / "w"))
    assert files.read_summary(spark, str(tmp_path / "w")).first().x == "a|b"


def test_every_summary_of_a_file_is_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"}} {{ {i}", None if i else "x") for i in range(5)], "n long, t string, e string").coalesce(1)
    files.write_summary(rows, str(tmp_path / "w"))
    (tmp_path / "w" / "more.json").write_text('{"n": 7,\n "t": "a"}\n\n{\n"n": 8\n}\n')
    got = sorted(tuple(r) for r in files.read_summary(spark, str(tmp_path / "w")).select("n", "t", "e").collect())
    assert got == [(0, "} { 0", "x"), *((i, f"}} {{ {i}", None) for i in range(1, 5)), (7, "a", None), (8, None, None)]
    typed = files.read_summary(spark, str(tmp_path / "w"), "n long")
    assert typed.columns == ["n"] and typed.count() == 7


def test_detail_cells_keep_their_white_space(spark, tmp_path):
    cells = ["  lead and trail  ", "ends in newline\n", "\t", 'a "quoted" \\ one', "x,y", " "]
    files.write_detail(spark.createDataFrame([(c,) for c in cells], "c string"), str(tmp_path / "d"))
    assert sorted(r.c for r in files.read_labelled_set(spark, str(tmp_path / "d"), ["c"]).collect()) == sorted(cells)


def test_columns_must_be_those_of_the_header(spark, tmp_path):
    (tmp_path / "set.csv").write_text("query,id\nx,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_labelled_set(spark, str(tmp_path / "set.csv"), ["id", "query"]).collect()


def test_sequence_follows_the_files(spark, tmp_path):
    for name, lines in (("b", "1,later\n1,last\n"), ("a", "1,first\n2,only\n")):
        (tmp_path / f"{name}.csv").write_text("id,v\n" + lines)
    rows = files.read_labelled_set(spark, str(tmp_path), sequence="seq")
    assert {r.id: r.v for r in last_per_id(rows, "seq").collect()} == {"1": "last", "2": "only"}


def test_objects_that_are_no_variants(spark, tmp_path):
    lines = ['{"status_code": 1, "status_code": 502, "query": "q"}', '{"latency_ms": NaN, "top_k": 3, "source_docs": ["a"]}', '{"a": 1, "a": 2', '{"latency_ms": "1d"}', '{"status_code": 12.5}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows = log_files.read_request_log(spark, str(tmp_path)).orderBy(*log_files.LOG_ORDER).collect()
    assert [(r.status_code, r.top_k, r.source_docs) for r in rows] == [(502, 0, []), (0, 3, ["a"]), (0, 0, []), (12, 0, [])]
    assert math.isnan(rows[1].latency_ms) and [rows[i].latency_ms for i in (0, 2, 3)] == [0.0, 0.0, 0.0]


def test_log_operators_on_a_log_read_from_files(spark, tmp_path):
    events = [{"ts": "2026-02-16T17:21:12Z", "status_code": 500 + i, "latency_ms": i % 2, "error": str(i), "endpoint": "/ask", "query": "q"} for i in range(6)]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(e) for e in events))
    log = log_files.read_request_log(spark, str(tmp_path))
    assert [r.error for r in logs.error_samples(log, 2).collect()] == ["0", "1"]
    assert [r.status_code for r in logs.slowest_requests(log, 2).collect()] == [501, 503]
    assert logs.recent_latency_stats(log, last_n=1).first().avg_latency_ms == 1.0
    assert logs.log_summary(log, last_n=2).first().avg_latency_ms == 0.5
    assert logs.log_report(log).first().total_errors == 6
    marked = reuse.mark_reuse(log, ["query"], order=log_files.LOG_ORDER)
    assert sorted(r.status_code for r in marked.filter("not reused").collect()) == [500]


def test_bodies_are_read_tolerantly(spark):
    bodies = ['{"answer": "a", "citations": ["x", 3, null], "sources": [{"doc_name": "d", "chunk_id": 1}, 5], "confidence": "low"}', '{"answer": 7, "citations": "x", "sources": {}}', "{broken", "[1]", None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "qid int, body string")
    got = parse_responses(rows).orderBy("qid").collect()
    assert (got[0].answer, got[0].citations, got[0].confidence, got[0].prompt_style) == ("a", ["x", "3", ""], "low", "")
    assert [(s.doc_name, s.chunk_id) for s in got[0].sources] == [("d", 1), (None, None)]
    assert (got[1].answer, got[1].citations, got[1].sources) == ("7", [], [])
    assert all(r.answer is None and r.sources is None for r in got[2:])


LINES = [
    '{"ts": "2026-02-16T17:21:12+00:00", "endpoint": "/ask", "status_code": 200, "latency_ms": 1.5, "source_docs": ["a", "a"], "cache_hit": true}',
    "",
    "   ",
    "{broken",
    "123",
    '["list"]',
    '{"endpoint": "/ask", "status_code": "x", "latency_ms": "oops", "source_docs": "a", "ts": "soon"}',
    '{"status_code": "404", "latency_ms": 2, "ts": "2026-02-16T17:21:13Z", "error": "a|b"}',
    "{}",
]


def test_tolerant_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(LINES) + "\n")
    log = log_files.read_request_log(spark, str(tmp_path)).orderBy("log_file", "log_block", "log_row")
    rows = log.collect()
    assert [r.status_code for r in rows] == [200, 0, 404, 0]
    assert [r.latency_ms for r in rows] == [1.5, 0.0, 2.0, 0.0]
    assert [r.source_docs for r in rows] == [["a", "a"], [], [], []]
    assert [r.ts is not None for r in rows] == [True, False, True, False]
    assert [r.endpoint for r in rows] == ["/ask", "/ask", "", ""]
    order = ("log_file", "log_block", "log_row")
    assert logs.error_samples(log, 5, order).first().error == "a/b"
    assert tuple(logs.error_rate(log).first()) == (4, 1, 0.25)


def test_append(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.jsonl").write_text("\n".join(LINES))
    log = log_files.read_request_log(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):
        log_files.append_request_log(log.withColumn("latency_ms", F.col("latency_ms") + 0.0004), out)
    again = log_files.read_request_log(spark, out)
    assert again.count() == 8
    assert sorted(r.latency_ms for r in again.collect()) == [0.0] * 4 + [1.5] * 2 + [2.0] * 2
    assert again.filter(F.col("ts").isNotNull()).agg(F.min("ts")).first()[0] == log.agg(F.min("ts")).first()[0]
