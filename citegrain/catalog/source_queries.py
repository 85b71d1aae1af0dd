"""Round trips through the file formats: tables are written, read back and queried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.catalog.log_queries import SQL as LOG_SQL
from citegrain.catalog.views import SQL_STRIP_CHARS, request_log, table, with_views
from citegrain.operators import chunks, logs, reuse
from citegrain.plans.workdir import shared_dir
from citegrain.sources import documents as files
from citegrain.sources import request_log as log_files

DOCS_PER_FILE = 1000


def _text_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents as paragraph files, a folder per language; read whole and cut again."""
    out = shared_dir(s)
    docs = table(s, d, "documents")
    blank = F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n"))
    docs.select("lang", blank.alias("value")).write.option(
        "maxRecordsPerFile", DOCS_PER_FILE
    ).option("compression", "none").partitionBy("lang").text(out)
    read = files.read_text_documents(s, out)
    parts = chunks.paragraph_chunks(read.withColumn("doc_name", F.col("lang")))
    return parts.groupBy(F.col("doc_name").alias("lang")).agg(
        F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("characters")
    )


def _labelled_set(s: SparkSession, d: str) -> DataFrame:
    out = shared_dir(s)
    turns = table(s, d, "conversations").withColumn(
        "notes", F.when(F.col("role") == "user", F.concat(F.lit('said "'), "role", F.lit('"; '), "role"))
    )
    turns.write.option("header", True).option("escape", '"').csv(out)
    return files.read_labelled_set(s, out)


def _log_lines(s: SparkSession, d: str) -> DataFrame:
    """A log with junk between the lines, numbers as text, and fields left out."""
    out = shared_dir(s)
    text = F.col("endpoint") == "/search"
    status = F.to_json(F.struct(F.col("status_code").cast("string").alias("status_code")))
    number = F.to_json(F.struct("status_code"))
    rest = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
            "endpoint",
            "latency_ms",
            "provider",
            "prompt_style",
            "query",
            "top_k",
            "source_docs",
            "cache_hit",
            F.nullif("error", F.lit("")).alias("error"),
        )
    )
    body = F.when(text, status).otherwise(number)
    whole = F.concat(
        F.substring(body, F.lit(1), F.length(body) - 1), F.lit(","), F.substring(rest, F.lit(2), F.length(rest))
    )
    lines = request_log(s, d).select(whole.alias("value"))
    junk = table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    blank = table(s, d, "labels").select(F.lit("  ").alias("value"))
    numbers = table(s, d, "labels").select(F.col("doc_id").cast("string").alias("value"))
    lines.unionByName(junk).unionByName(blank).unionByName(numbers).write.text(out)
    return log_files.read_request_log(s, out)


def _shown_log(log: DataFrame) -> DataFrame:
    return log.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        "endpoint",
        "status_code",
        "latency_ms",
        "provider",
        "prompt_style",
        "query",
        "top_k",
        F.array_join("source_docs", "|").alias("source_docs"),
        F.col("cache_hit").cast("int").alias("cache_hit"),
        "error",
    )


def _log_in_order(s: SparkSession, d: str) -> DataFrame:
    """Log order from file positions: the log written to files in time order, and read back."""
    out = shared_dir(s)
    rows = request_log(s, d).orderBy("ts", "event_id")
    log_files.log_events(rows).write.json(out)
    return log_files.read_request_log(s, out)


def _shown_time(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), *columns)


def _odd_lines(s: SparkSession, d: str) -> DataFrame:
    """Log lines that repeat a key, hold NaN where no number is due, or a number's text with a suffix."""
    out = shared_dir(s)
    event = F.col("event_id").cast("string")
    kind = F.col("event_id") % 3
    line = F.concat(
        F.lit('{"endpoint":"/first","endpoint":"/ask","query":"q'), event, F.lit('","status_code":"'), event,
        F.lit('","latency_ms":'), F.when(kind == 0, '"1d"').when(kind == 1, '"2.5"').otherwise("3"),
        F.lit(',"top_k":'), F.when(kind == 1, "NaN").otherwise("4"), F.lit(',"source_docs":["a","b"]}'),
    )
    table(s, d, "events").select(line.alias("value")).write.text(out)
    return log_files.read_request_log(s, out).select(
        "endpoint", "query", "status_code", "latency_ms", "top_k", F.array_join("source_docs", "|").alias("source_docs")
    )


def _summary(s: SparkSession, d: str) -> DataFrame:
    """One summary for each endpoint, several in a file, and a pretty-printed one."""
    out = shared_dir(s)
    files.write_summary(logs.endpoint_stats(request_log(s, d)).coalesce(1), f"{out}/part=lines")
    total = logs.error_rate(request_log(s, d)).select(
        F.lit("all").alias("endpoint"), F.col("total_requests").alias("requests"), F.col("total_errors").alias("errors"), "error_rate"
    )
    pretty = F.to_json(F.struct("*"), {"pretty": "true"})
    total.select(pretty.alias("value")).write.text(f"{out}/part=pretty")
    return files.read_summary(s, out).select("endpoint", "requests", "errors", "error_rate")


def _detail_csv(s: SparkSession, d: str) -> DataFrame:
    """Cells with white space at both ends and line breaks, and cells that are lists."""
    out = shared_dir(s)
    padded = F.concat(F.lit("  "), "error", F.lit(" \n"))
    rows = request_log(s, d).select("event_id", "endpoint", "latency_ms", "source_docs", padded.alias("error"))
    files.write_detail(rows, out)
    return files.read_labelled_set(s, out, rows.columns)


def _repeats_of_files(s: SparkSession, d: str) -> DataFrame:
    """Repeated queries of a log read from files, whose order takes three columns."""
    log = logs.only_endpoint(_log_in_order(s, d))
    marked = reuse.mark_repeats(log, ["query"], order=log_files.LOG_ORDER, ttl_sec=86400)
    return marked.groupBy("query").agg(F.count_if("repeated").alias("repeats"), F.count("*").alias("requests"))


def _appended(s: SparkSession, d: str) -> DataFrame:
    """Two appends: the /ask requests, then the others with a latency to be rounded."""
    out = shared_dir(s)
    log = request_log(s, d)
    log_files.append_request_log(logs.only_endpoint(log), out)
    others = log.filter(F.col("endpoint") != "/ask").withColumn("latency_ms", F.col("latency_ms") + 0.0001)
    log_files.append_request_log(others, out)
    return _shown_log(log_files.read_request_log(s, out))


QUERIES = {
    "a1_text_documents": _text_documents,
    "a2_labelled_set": _labelled_set,
    "a3_tolerant_log": lambda s, d: _shown_log(_log_lines(s, d)),
    "a3_odd_log_lines": _odd_lines,
    "a3_h7_recent_latency_of_files": lambda s, d: logs.recent_latency_stats(_log_in_order(s, d)),
    "a3_h11_slowest_of_files": lambda s, d: _shown_time(
        logs.slowest_requests(_log_in_order(s, d)), "endpoint", "status_code", "latency_ms", "query"
    ),
    "a3_h12_errors_in_log_order": lambda s, d: _shown_time(
        logs.error_samples(_log_in_order(s, d)), "endpoint", "status_code", "error", "query"
    ),
    "a3_h13_summary_of_files": lambda s, d: logs.log_summary(_log_in_order(s, d)),
    "a3_e7_repeats_in_log_order": _repeats_of_files,
    "a4_a7_summary_files": _summary,
    "a6_detail_table": _detail_csv,
    "a8_appended_log": _appended,
}

_LOG = with_views(
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, endpoint, status_code, latency_ms, provider, prompt_style,
         query, top_k, array_to_string(source_docs, '|') AS source_docs, CAST(cache_hit AS INT) AS cache_hit, error
       FROM request_log""",
    "request_log",
)

SQL = {
    "a1_text_documents": f"""
        SELECT lang, count(*) AS paragraphs, CAST(sum(length(p)) AS BIGINT) AS characters
        FROM (SELECT lang, trim(unnest(string_split(text, chr(10))), {SQL_STRIP_CHARS}) AS p FROM documents)
        WHERE p <> '' GROUP BY lang""",
    "a2_labelled_set": """
        SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text,
          CASE WHEN role = 'user' THEN 'said "' || role || '"; ' || role ELSE '' END AS notes
        FROM conversations""",
    "a3_tolerant_log": _LOG,
    "a3_h12_errors_in_log_order": with_views(
        """SELECT strftime(request_log.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, endpoint, status_code,
             replace(error, '|', '/') AS error, query
           FROM request_log WHERE status_code >= 400 ORDER BY request_log.ts, event_id LIMIT 5""",
        "request_log",
    ),
    "a3_odd_log_lines": """
        SELECT '/ask' AS endpoint, 'q' || event_id AS query, event_id AS status_code,
          CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2.5 ELSE 3 END AS DOUBLE) AS latency_ms,
          CAST(CASE event_id % 3 WHEN 1 THEN 0 ELSE 4 END AS BIGINT) AS top_k, 'a|b' AS source_docs FROM events""",
    "a3_h7_recent_latency_of_files": LOG_SQL["h7_recent_latency"],
    "a3_h11_slowest_of_files": f"SELECT * EXCLUDE (event_id) FROM ({LOG_SQL['h11_slowest_requests']})",
    "a3_h13_summary_of_files": LOG_SQL["h13_log_summary"],
    "a3_e7_repeats_in_log_order": with_views(
        """SELECT query, count(*) FILTER (epoch_us(ts) <= before + 86400000000) AS repeats, count(*) AS requests
           FROM (SELECT query, ts, lag(epoch_us(ts)) OVER (PARTITION BY query ORDER BY ts, event_id) AS before
                 FROM request_log WHERE endpoint = '/ask') GROUP BY query""",
        "request_log",
    ),
    "a4_a7_summary_files": f"""
        SELECT * FROM ({LOG_SQL['h8_endpoint_stats']}) UNION ALL
        SELECT 'all', * FROM ({LOG_SQL['h5_error_rate']})""",
    "a6_detail_table": with_views(
        """SELECT CAST(event_id AS VARCHAR) AS event_id, endpoint, CAST(latency_ms AS VARCHAR) AS latency_ms,
             array_to_string(source_docs, '|') AS source_docs, '  ' || error || ' ' || chr(10) AS error FROM request_log""",
        "request_log",
    ),
    "a8_appended_log": _LOG,
}
