"""Prompts, answer records, retrieval evaluation, run comparison and answer quality.

Questions are the vectors of `embeddings`, hits their nearest others among all documents and vectors.
Every event belongs to a question, counted round; a response takes its status, latency and error from
its question's last event, and one without an event is a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.catalog.retrieval_queries import (
    sql_preview,
    sql_vector_hits,
    vector_hits,
    with_texts,
)
from citegrain.catalog.views import (
    SQL_STRIP_CHARS,
    conversation_answers,
    request_log,
    table,
    vector_questions,
    with_views,
)
from citegrain.functions import text as tx
from citegrain.functions import values as vl
from citegrain.operators import answers, compare, quality, retrieval_eval
from citegrain.plans.workdir import shared_dir, written
from citegrain.sources.documents import read_labelled_set, write_detail
from citegrain.sources.responses import parse_responses


def _questions(s: SparkSession, d: str) -> DataFrame:
    return vector_questions(s, d).drop("embedding")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """The questions with their keywords, written once because answers and scores of all runs read them."""
    return written(_questions(s, d))


def _shown_hits(s: SparkSession, d: str) -> DataFrame:
    """Hits with as much of their texts as a record shows."""
    return vector_hits(s, d, chars=answers.SHOWN_CHARS)


def _records(s: SparkSession, d: str, hits: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    return answers.answer_records(_questions(s, d) if asked is None else asked, hits, style=F.col("style"))


def _responses(records: DataFrame, s: SparkSession, d: str) -> DataFrame:
    log, n_questions = request_log(s, d), table(s, d, "embeddings").count()
    last = F.max(F.struct("event_id", "status_code", "latency_ms", "error")).alias("last")
    served = log.groupBy((F.col("event_id") % n_questions).alias("qid")).agg(last)
    ok = F.col("last.status_code") == 200
    body = ("answer", "confidence", "prompt_style", "citations", "sources")
    return records.join(served, "qid", "left").select(
        "qid",
        F.coalesce("last.status_code", F.lit(0)).cast("bigint").alias("http_status"),
        F.coalesce("last.latency_ms", F.lit(0.0)).alias("latency_ms"),
        F.coalesce("last.error", F.lit("")).alias("error"),
        *[F.when(ok, F.col(c)).alias(c) for c in body],
    )


def _scored(s: SparkSession, d: str, short: bool = False, asked: DataFrame | None = None) -> DataFrame:
    asked = _asked(s, d) if asked is None else asked
    hits = vector_hits(s, d, 3, short, attach=())  # only answers need the texts
    return retrieval_eval.scored_questions(
        asked.withColumn("notes", F.col("style")),
        hits,
        _responses(_records(s, d, with_texts(s, d, hits, chars=answers.SHOWN_CHARS), asked), s, d),
    )


def _detail(s: SparkSession, d: str, short: bool = False, asked: DataFrame | None = None) -> DataFrame:
    return retrieval_eval.eval_detail(_scored(s, d, short, asked))


def _two_runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The baseline's detail table, and the candidate's appended to it in order of writing."""
    asked = _asked(s, d)
    # both written: sorting takes a sample first, which would make every answer and score twice
    first, second = (written(_detail(s, d, n == 0, asked).withColumn("seq", F.lit(n))) for n in (0, 1))
    return first, first.unionByName(second)


def _rerun(s: SparkSession, d: str) -> DataFrame:
    return _two_runs(s, d)[1]


def _deltas(s: SparkSession, d: str) -> DataFrame:
    baseline, rerun = _two_runs(s, d)
    return compare.paired_deltas(baseline, rerun, "seq")


def _retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    asked = _asked(s, d)
    return compare.metric_table(*(written(compare.run_aggregate(_detail(s, d, short, asked))) for short in (True, False)))


def _shown_deltas(df: DataFrame) -> DataFrame:
    return df.withColumn("delta_kw", F.round("delta_kw", 3))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _quality_runs(s: SparkSession, d: str) -> DataFrame:
    """Two runs: one with its own citations, one still citing the short vectors' hits."""
    records = written(_records(s, d, _shown_hits(s, d)))
    # only labels are stale, so the old run's hits need no texts
    label = F.struct("rank", tx.chunk_label("doc_name", "chunk_id").alias("label"))
    old_hits = vector_hits(s, d, short=True, attach=()).groupBy("qid").agg(F.array_sort(F.collect_list(label)).alias("old"))
    stale = old_hits.withColumn("old", F.transform("old", lambda x: x["label"]))
    fresh = _responses(records, s, d).withColumn("tag", F.lit("fresh"))
    old = (
        _responses(records.join(stale, "qid").withColumn("citations", F.col("old")), s, d)
        .withColumn("tag", F.lit("stale"))
    )
    return fresh.unionByName(old)


def _from_bodies(s: SparkSession, d: str) -> DataFrame:
    """Fresh responses as JSON bodies, some broken, some with lists that are none; read back and scored."""
    told = _responses(written(_records(s, d, _shown_hits(s, d))), s, d)
    kind = F.col("qid") % 5
    body = F.to_json(F.struct("answer", "confidence", "prompt_style", "citations", "sources"))
    odd = F.to_json(F.struct("answer", "confidence", F.lit("none").alias("citations"), F.lit(3).alias("sources")))
    body = F.when(kind == 0, F.lit("{broken")).when(kind == 1, odd).otherwise(body)
    bodies = written(told.select("qid", "http_status", "latency_ms", "error", F.when(F.col("http_status") == 200, body).alias("body")))
    return quality.quality_rows(quality.quality_detail(_questions(s, d), parse_responses(bodies)))


def _deltas_from_files(s: SparkSession, d: str) -> DataFrame:
    """Both runs' detail tables written as CSV and read back; the files' order says which row is last."""
    read = []
    for run in _two_runs(s, d):
        out = shared_dir(s)
        write_detail(run.orderBy("seq").drop("seq"), out)
        read.append(read_labelled_set(s, out, sequence="seq"))
    return _shown_deltas(compare.paired_deltas(*read, "seq"))


def _quality_detail(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_detail(_questions(s, d), _quality_runs(s, d), extra=["tag"])


def _quality_metrics(s: SparkSession, d: str) -> DataFrame:
    per_tag = written(quality.quality_summary(_quality_detail(s, d), ["tag"]))
    return compare.metric_table(
        per_tag.filter(F.col("tag") == "fresh"),
        per_tag.filter(F.col("tag") == "stale"),
        compare.QUALITY_METRICS,
    )


def _flat_record(df: DataFrame) -> DataFrame:
    """Lists as joined text, to compare with plain SQL."""
    shown = F.transform(
        "sources",
        lambda h: F.concat(
            tx.chunk_label(h["doc_name"], h["chunk_id"]), F.lit(" "), h["text"]
        ),
    )
    return df.withColumns(
        {
            "grounded": F.col("grounded").cast("int"),
            "citations": F.array_join("citations", "|"),
            "sources": F.array_join(shown, "\n"),
        }
    )


def _echoed(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations")
    return turns.select("conv_id", "turn", answers.echo_prompt(F.col("text")).alias("answer"))


def _generated(s: SparkSession, d: str) -> DataFrame:
    """The generator seam: a vectorized function from prompt to answer text."""

    @F.pandas_udf("string")
    def one_line(prompt):  # type: ignore[no-untyped-def]
        return "[one line] " + prompt.str.replace("\n", " ", regex=False)

    records = answers.answer_records(
        _questions(s, d), vector_hits(s, d), provider="one-line", style=F.col("style"), generate=one_line
    )
    return records.select("qid", "provider", "prompt_style", F.md5("answer").alias("answer_md5"))


def _recall(s: SparkSession, d: str) -> DataFrame:
    pairs = conversation_answers(s, d)
    return pairs.select(
        "conv_id",
        "turn",
        F.size(tx.split_list("expected_keywords")).alias("n_keywords"),
        F.round(vl.keyword_recall("answer", tx.split_list("expected_keywords")), 6).alias("recall"),
    )


def _lists(s: SparkSession, d: str) -> DataFrame:
    """Each document's lines as one delimited cell, read back as list and as set."""
    cell = F.replace(F.replace(F.col("text"), F.lit(";"), F.lit(",")), F.lit("\n"), F.lit(" ; "))
    piped = F.replace(F.replace(F.col("text"), F.lit("|"), F.lit(",")), F.lit(" "), F.lit(" | "))
    return table(s, d, "documents").select(
        "doc_id",
        F.array_join(tx.split_list(cell), "\n").alias("items"),
        F.size(tx.split_set(piped)).alias("n_words"),
    )


def _casts(s: SparkSession, d: str) -> DataFrame:
    """Numbers and words of the log read leniently from text cells."""
    log = table(s, d, "events")
    return log.select(
        "event_id",
        vl.lenient_int(F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.col("user_id").cast("string"))).alias("as_int"),
        vl.lenient_float(F.when(F.col("event_type") == "click", F.lit("")).otherwise(F.col("value").cast("string"))).alias("as_float"),
        F.date_format(
            vl.lenient_timestamp(
                F.when(F.col("event_type") == "error", "not a time").otherwise(
                    F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
                )
            ),
            "yyyy-MM-dd HH:mm:ss.SSSSSS",
        ).alias("as_time"),
    )


QUERIES = {
    "b7_delimited_lists": _lists,
    "b9_b10_lenient_casts": _casts,
    "e1_e2_e3_prompts": lambda s, d: answers.prompts(
        _questions(s, d), vector_hits(s, d), style=F.col("style")
    ),
    "e4_e5_answer_records": lambda s, d: _flat_record(_records(s, d, _shown_hits(s, d))),
    "e8_echo_generator": _echoed,
    "e8_plugged_generator": _generated,
    "f1_f2_f4_eval_detail": _detail,
    "f3_keyword_recall": _recall,
    "f4_retrieval_only_detail": lambda s, d: retrieval_eval.eval_detail(
        retrieval_eval.scored_questions(_questions(s, d), vector_hits(s, d))
    ),
    "f5_eval_summary": lambda s, d: _rounded(
        retrieval_eval.eval_summary(_scored(s, d)), "search_hit_rate", "ask_hit_rate", "avg_keyword_recall"
    ),
    "g1_run_aggregate": lambda s, d: _rounded(
        compare.run_aggregate(_rerun(s, d)), *compare.RETRIEVAL_METRICS
    ),
    "g2_last_per_id": lambda s, d: compare.last_per_id(_rerun(s, d), "seq").select(
        "id", "seq", "search_docs", "keyword_recall"
    ),
    "g3_g4_paired_deltas": lambda s, d: _shown_deltas(_deltas(s, d)),
    "g3_deltas_from_files": _deltas_from_files,
    "g5_change_counts": lambda s, d: compare.change_counts(_deltas(s, d)),
    "g5_regressed": lambda s, d: _shown_deltas(compare.with_change(_deltas(s, d), "regressed")),
    "g6_retrieval_metrics": lambda s, d: _rounded(_retrieval_metrics(s, d), "baseline", "candidate", "delta"),
    "g6_quality_metrics": lambda s, d: _rounded(_quality_metrics(s, d), "delta"),
    "g7_recommendation": lambda s, d: compare.recommendation(_quality_metrics(s, d)),
    "i1_to_i6_quality_detail": lambda s, d: quality.quality_rows(_quality_detail(s, d)),
    "i1_to_i6_from_bodies": _from_bodies,
    "i7_quality_summary": lambda s, d: quality.quality_summary(_quality_detail(s, d)),
    "i7_quality_by_style_and_tag": lambda s, d: quality.quality_summary(
        _quality_detail(s, d), ["prompt_style_resp", "tag"]
    ),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_filled(template: str, **values: str) -> str:
    """The template as a concatenation with SQL expressions in its ``{name}`` places."""
    out, rest = [], template
    for name in sorted(values, key=lambda n: template.index("{" + n + "}")):
        head, rest = rest.split("{" + name + "}", 1)
        out += [_quoted(head), values[name]]
    return " || ".join([*out, _quoted(rest)])


_STYLE = f"""CASE WHEN lower(trim(style, {SQL_STRIP_CHARS})) IN ('v1', 'v2')
    THEN lower(trim(style, {SQL_STRIP_CHARS})) ELSE 'v1' END"""

_PROMPTS = f"""
    SELECT qid, query, prompt_style, context,
      CASE WHEN prompt_style = 'v2' THEN {sql_filled(answers.PROMPTS['v2'], question='query', context='context')}
        ELSE {sql_filled(answers.PROMPTS['v1'], question='query', context='context')} END AS prompt
    FROM (SELECT q.qid, q.query, {_STYLE} AS prompt_style,
            string_agg('[' || doc_name || '#chunk' || chunk_id || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context
          FROM vector_questions q JOIN hits h ON h.qid = q.qid
          GROUP BY q.qid, q.query, style)"""


def _sql_records(hits: str) -> str:
    label = "doc_name || '#chunk' || chunk_id"
    echo = sql_filled(answers.ECHO_ANSWER, style="prompt_style", question="question", context="heads")
    return f"""
        SELECT qid, 'echo' AS provider, question, prompt_style, {echo} AS answer, confidence,
          grounded, citations, sources, docs
        FROM (SELECT q.qid, q.query AS question, {_STYLE} AS prompt_style,
                string_agg(substr(replace(text, chr(10), ' '), 1, 80), '；' ORDER BY rank) FILTER (rank <= 2) AS heads,
                CASE WHEN max(score) >= 0.75 THEN 'high' WHEN max(score) >= 0.55 THEN 'medium' ELSE 'low' END AS confidence,
                1 AS grounded,
                string_agg({label}, '|' ORDER BY rank) AS citations,
                string_agg({label} || ' ' || {sql_preview('text', 220)}, chr(10) ORDER BY rank) AS sources,
                list(doc_name ORDER BY rank) AS docs
              FROM vector_questions q JOIN {hits} h ON h.qid = q.qid
              GROUP BY q.qid, q.query, style)"""


_EVENTS = """
    SELECT vec_id AS qid, CAST(coalesce(status_code, 0) AS BIGINT) AS http_status, coalesce(latency_ms, 0) AS latency_ms,
      coalesce(error, '') AS err
    FROM embeddings LEFT JOIN (
      SELECT event_id % (SELECT count(*) FROM embeddings) AS vec_id, arg_max(status_code, event_id) AS status_code,
        arg_max(latency_ms, event_id) AS latency_ms, arg_max(error, event_id) AS error
      FROM request_log GROUP BY ALL) USING (vec_id)"""


def _sql_recall(answer: str, keywords: str) -> str:
    return f"""coalesce(len(list_filter({keywords}, lambda kw: contains({answer}, kw)))
        / nullif(len({keywords}), 0), 0)"""


_KEYWORDS = "list_filter(string_split(expected_keywords, ';'), lambda w: w <> '')"


def _sql_scored(records: str) -> str:
    return f"""
        SELECT q.qid, q.query, q.expected_doc, q.style, r.docs, e.http_status,
          CAST(list_contains(r.docs, q.expected_doc) AS INT) AS search_hit,
          CAST(e.http_status = 200 AND list_contains(r.docs, q.expected_doc) AS INT) AS ask_hit,
          CASE WHEN e.http_status = 200 THEN r.answer ELSE '' END AS answer,
          CASE WHEN e.http_status = 200 THEN {_sql_recall('r.answer', _KEYWORDS)} ELSE 0 END AS recall
        FROM vector_questions q JOIN {records} r ON r.qid = q.qid JOIN served e ON e.qid = q.qid"""


def _sql_detail(scored: str) -> str:
    return f"""
        SELECT qid AS id, query, expected_doc, 200 AS search_status,
          array_to_string(docs, '|') AS search_docs, search_hit AS search_hit_expected_doc,
          http_status AS ask_status,
          CASE WHEN http_status = 200 THEN array_to_string(docs, '|') ELSE '' END AS ask_source_docs,
          ask_hit AS ask_hit_expected_doc, round(recall, 3) AS keyword_recall,
          substr(replace(answer, chr(10), ' '), 1, 200) AS answer_preview,
          '' AS manual_answer_score_0_2, '' AS manual_source_score_0_2, style AS manual_notes
        FROM {scored}"""


_RUNS = {
    "hits": sql_vector_hits(3),
    "short_hits": sql_vector_hits(3, short=True),
    "served": _EVENTS,
    "records": _sql_records("hits"),
    "short_records": _sql_records("short_hits"),
    "scored": _sql_scored("records"),
    "short_scored": _sql_scored("short_records"),
    "detail": _sql_detail("scored"),
    "short_detail": _sql_detail("short_scored"),
    "rerun": "SELECT *, 0 AS seq FROM short_detail UNION ALL SELECT *, 1 AS seq FROM detail",
    "deltas": """
        SELECT CAST(b.id AS VARCHAR) AS id, c.query, b.keyword_recall AS baseline_kw, c.keyword_recall AS candidate_kw,
          c.keyword_recall - b.keyword_recall AS delta_kw, b.ask_source_docs AS baseline_docs,
          c.ask_source_docs AS candidate_docs,
          CASE WHEN c.keyword_recall - b.keyword_recall > 1e-9 THEN 'improved'
            WHEN c.keyword_recall - b.keyword_recall < -1e-9 THEN 'regressed' ELSE 'unchanged' END AS change
        FROM short_detail b JOIN detail c USING (id)""",
    "quality": f"""
        SELECT q.qid AS id, tag, q.query, q.expected_doc, e.http_status, round(e.latency_ms, 3) AS latency_ms,
          CAST(ok AS INT) AS format_ok,
          CAST(ok AND len(list_filter(cites, lambda c: NOT list_contains(labels, c))) = 0 AS INT) AS citation_compliant,
          CAST(ok AND len(list_filter(cites, lambda c: starts_with(c, q.expected_doc || '#'))) > 0 AS INT) AS expected_doc_cited,
          CASE WHEN ok THEN {_sql_recall('r.answer', _KEYWORDS)} ELSE 0 END AS keyword_recall,
          CASE WHEN ok THEN r.confidence ELSE '' END AS confidence,
          CASE WHEN ok THEN r.prompt_style ELSE '' END AS prompt_style_resp,
          CASE WHEN ok THEN array_to_string(list_sort(cites), '|') ELSE '' END AS citations,
          CASE WHEN ok THEN r.citations ELSE '' END AS source_labels,
          CASE WHEN ok THEN substr(replace(r.answer, chr(10), ' '), 1, 220) ELSE '' END AS answer_preview,
          e.err AS error
        FROM vector_questions q
        JOIN (SELECT *, http_status = 200 AS ok FROM served) e ON e.qid = q.qid
        JOIN (SELECT *, string_split(citations, '|') AS labels FROM records) r ON r.qid = q.qid
        JOIN (SELECT qid, 'fresh' AS tag, string_split(citations, '|') AS cites FROM records
              UNION ALL SELECT qid, 'stale', string_split(citations, '|') FROM short_records) c ON c.qid = q.qid""",
}


def _over_runs(sql: str) -> str:
    return with_views(sql, "request_log", "vector_chunks", "vector_questions", **_RUNS)


_QUALITY_RATES = """
    count(*) AS total, round(avg(CAST(http_status = 200 AS INT)), 4) AS http_success_rate,
    round(avg(format_ok), 4) AS format_ok_rate,
    round(avg(citation_compliant), 4) AS citation_compliance_rate,
    round(avg(expected_doc_cited), 4) AS expected_doc_cited_rate,
    round(avg(keyword_recall), 4) AS avg_keyword_recall, round(avg(latency_ms), 3) AS avg_latency_ms"""


def _metric_rows(baseline: str, candidate: str, metrics: tuple[str, ...], rounded: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, b.{m} AS baseline, c.{m} AS candidate, c.{m} - b.{m} AS delta FROM b, c"
        for m in metrics
    )
    return f"SELECT metric, {rounded} FROM (WITH b AS ({baseline}), c AS ({candidate}) {rows})"


_DETAIL_RATES = """SELECT avg(search_hit_expected_doc) AS search_hit_rate,
    avg(ask_hit_expected_doc) AS ask_hit_rate, avg(keyword_recall) AS avg_keyword_recall FROM """

_SHOWN_DELTAS = """SELECT id, query, baseline_kw, candidate_kw, round(delta_kw, 3) AS delta_kw,
    baseline_docs, candidate_docs, change FROM deltas"""

SQL = {
    "b7_delimited_lists": f"""
        SELECT doc_id,
          array_to_string(list_filter(list_transform(string_split(replace(text, ';', ','), chr(10)),
            lambda p: trim(p, {SQL_STRIP_CHARS})), lambda p: p <> ''), chr(10)) AS items,
          CAST(len(list_distinct(list_filter(list_transform(string_split(replace(text, '|', ','), ' '),
            lambda p: trim(p, {SQL_STRIP_CHARS})), lambda p: p <> ''))) AS INT) AS n_words
        FROM documents""",
    "b9_b10_lenient_casts": """
        SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS as_int,
          CASE WHEN event_type = 'click' THEN 0 ELSE value END AS as_float,
          CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS as_time
        FROM events""",
    "e1_e2_e3_prompts": with_views(
        _PROMPTS, "vector_chunks", "vector_questions", hits=sql_vector_hits(3)
    ),
    "e4_e5_answer_records": with_views(
        "SELECT * EXCLUDE (docs) FROM records",
        "vector_chunks",
        "vector_questions",
        hits=sql_vector_hits(3),
        records=_sql_records("hits"),
    ),
    "e8_echo_generator": """
        SELECT conv_id, turn, '[echo] ' || text AS answer FROM conversations""",
    "e8_plugged_generator": with_views(
        """SELECT qid, 'one-line' AS provider, prompt_style,
             md5('[one line] ' || replace(prompt, chr(10), ' ')) AS answer_md5 FROM prompts""",
        "vector_chunks",
        "vector_questions",
        hits=sql_vector_hits(3),
        prompts=_PROMPTS,
    ),
    "f1_f2_f4_eval_detail": _over_runs("SELECT * FROM detail"),
    "f3_keyword_recall": with_views(
        f"""SELECT conv_id, turn, CAST(len({_KEYWORDS}) AS INT) AS n_keywords,
              round({_sql_recall('answer', _KEYWORDS)}, 6) AS recall FROM conversation_answers""",
        "conversation_answers",
    ),
    "f4_retrieval_only_detail": _over_runs(
        """SELECT id, query, expected_doc, search_status, search_docs, search_hit_expected_doc,
             '' AS ask_status, '' AS ask_source_docs, '' AS ask_hit_expected_doc, '' AS keyword_recall,
             '' AS answer_preview, '' AS manual_answer_score_0_2, '' AS manual_source_score_0_2,
             '' AS manual_notes FROM detail"""
    ),
    "f5_eval_summary": _over_runs(
        """SELECT count(*) AS total, round(avg(search_hit), 6) AS search_hit_rate,
             round(avg(ask_hit), 6) AS ask_hit_rate,
             round(sum(recall) FILTER (http_status = 200) / count(*) FILTER (http_status = 200), 6) AS avg_keyword_recall
           FROM scored"""
    ),
    "g1_run_aggregate": _over_runs(
        """SELECT CAST(count(*) AS DOUBLE) AS total, round(avg(search_hit_expected_doc), 6) AS search_hit_rate,
             round(avg(ask_hit_expected_doc), 6) AS ask_hit_rate,
             round(avg(keyword_recall), 6) AS avg_keyword_recall FROM rerun"""
    ),
    "g2_last_per_id": _over_runs(
        """SELECT CAST(id AS VARCHAR) AS id, seq, search_docs, keyword_recall
           FROM rerun QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""
    ),
    "g3_g4_paired_deltas": _over_runs(_SHOWN_DELTAS),
    "g3_deltas_from_files": _over_runs(_SHOWN_DELTAS),
    "g5_change_counts": _over_runs(
        """SELECT count(*) FILTER (change = 'improved') AS improved,
             count(*) FILTER (change = 'regressed') AS regressed,
             count(*) FILTER (change = 'unchanged') AS unchanged FROM deltas"""
    ),
    "g5_regressed": _over_runs(_SHOWN_DELTAS + " WHERE change = 'regressed'"),
    "g6_retrieval_metrics": _over_runs(
        _metric_rows(
            _DETAIL_RATES + "short_detail",
            _DETAIL_RATES + "detail",
            compare.RETRIEVAL_METRICS,
            "round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(delta, 6) AS delta",
        )
    ),
    "g6_quality_metrics": _over_runs(
        _metric_rows(
            f"SELECT {_QUALITY_RATES} FROM quality WHERE tag = 'fresh'",
            f"SELECT {_QUALITY_RATES} FROM quality WHERE tag = 'stale'",
            compare.QUALITY_METRICS,
            "baseline, candidate, round(delta, 6) AS delta",
        )
    ),
    "g7_recommendation": _over_runs(
        f"""SELECT CASE WHEN c.http_success_rate < b.http_success_rate THEN {_quoted(compare.DROP_RULES[0][1])}
              WHEN c.format_ok_rate < b.format_ok_rate THEN {_quoted(compare.DROP_RULES[1][1])}
              WHEN c.citation_compliance_rate < b.citation_compliance_rate THEN {_quoted(compare.DROP_RULES[2][1])}
              WHEN c.avg_keyword_recall >= b.avg_keyword_recall THEN {_quoted(compare.KEEP)}
              ELSE {_quoted(compare.REVIEW)} END AS recommendation
            FROM (SELECT {_QUALITY_RATES} FROM quality WHERE tag = 'fresh') b,
                 (SELECT {_QUALITY_RATES} FROM quality WHERE tag = 'stale') c"""
    ),
    "i1_to_i6_quality_detail": _over_runs(
        "SELECT * REPLACE (round(keyword_recall, 3) AS keyword_recall) FROM quality"
    ),
    "i1_to_i6_from_bodies": _over_runs(
        """SELECT id, query, expected_doc, http_status, latency_ms,
             CASE WHEN id % 5 = 0 THEN 0 ELSE format_ok END AS format_ok,
             CASE WHEN id % 5 < 2 THEN 0 ELSE citation_compliant END AS citation_compliant,
             CASE WHEN id % 5 < 2 THEN 0 ELSE expected_doc_cited END AS expected_doc_cited,
             CASE WHEN id % 5 = 0 THEN 0 ELSE round(keyword_recall, 3) END AS keyword_recall,
             CASE WHEN id % 5 = 0 THEN '' ELSE confidence END AS confidence,
             CASE WHEN id % 5 < 2 THEN '' ELSE prompt_style_resp END AS prompt_style_resp,
             CASE WHEN id % 5 < 2 THEN '' ELSE citations END AS citations,
             CASE WHEN id % 5 < 2 THEN '' ELSE source_labels END AS source_labels,
             CASE WHEN id % 5 = 0 THEN '' ELSE answer_preview END AS answer_preview, error
           FROM quality WHERE tag = 'fresh'"""
    ),
    "i7_quality_summary": _over_runs(f"SELECT {_QUALITY_RATES} FROM quality"),
    "i7_quality_by_style_and_tag": _over_runs(
        f"SELECT prompt_style_resp, tag, {_QUALITY_RATES} FROM quality GROUP BY ALL"
    ),
}
