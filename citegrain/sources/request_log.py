"""The request log: one JSON object per line, read tolerantly, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.functions.text import strip
from citegrain.functions.values import lenient_float, lenient_int, lenient_timestamp

LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("status_code", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("provider", T.StringType()),
        T.StructField("prompt_style", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("top_k", T.LongType()),
        T.StructField("source_docs", T.ArrayType(T.StringType())),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


#: Every field as the text it has in the line, and whether the line is broken.
_LOOSE = T.StructType([T.StructField(c, T.StringType()) for c in (*LOG_SCHEMA.fieldNames(), "_broken")])

#: The columns that put a log read from files in the order of its lines.
LOG_ORDER = ("log_file", "log_block", "log_row")


def parse_log_lines(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed log rows from text lines in ``value``.

    Blank lines, lines that do not parse and lines that are no JSON object are skipped. A row
    whose fields are missing or mistyped stays: numbers fall back to 0, text to ``""``,
    ``source_docs`` to an empty list and ``ts`` to NULL. Objects that repeat a key (the last
    counts) or hold ``NaN`` are no variants; they are read field by field.
    """
    event = F.try_parse_json(F.col("value"))
    loose = F.from_json("value", _LOOSE, {"columnNameOfCorruptRecord": "_broken", "allowNonNumericNumbers": "true"})
    objects = (
        lines.select(*keep, event.alias("event"), F.when(event.isNull() & strip("value").startswith("{"), loose).alias("loose"))
        .filter(F.schema_of_variant("event").startswith("OBJECT") | (F.col("loose").isNotNull() & F.col("loose._broken").isNull()))
    )

    def field(name: str, kind: str):
        read = F.try_variant_get("event", f"$.{name}", kind)
        if kind.startswith("array"):
            return F.coalesce(read, F.from_json(f"loose.{name}", kind))
        # a bare NaN comes out of the field in quotes
        return F.coalesce(read, F.regexp_replace(f"loose.{name}", '^"(NaN|-?Infinity)"$', "$1").try_cast(kind))

    def text(name: str):
        return F.coalesce(field(name, "string"), F.lit("")).alias(name)

    def is_text(name: str):
        kind = F.schema_of_variant(F.try_variant_get("event", f"$.{name}", "variant"))
        return F.coalesce(kind == "STRING", F.lit(False)) | F.col("loose").isNotNull()

    def whole(name: str):
        number = F.coalesce(field(name, "bigint"), F.lit(0).cast("bigint"))
        return F.when(is_text(name), lenient_int(field(name, "string"))).otherwise(number).alias(name)

    def decimal(name: str):
        number = F.coalesce(field(name, "double"), F.lit(0.0))
        return F.when(is_text(name), lenient_float(field(name, "string"))).otherwise(number).alias(name)

    return objects.select(
        *keep,
        lenient_timestamp(field("ts", "string")).alias("ts"),
        text("endpoint"),
        whole("status_code"),
        decimal("latency_ms"),
        text("provider"),
        text("prompt_style"),
        text("query"),
        whole("top_k"),
        F.coalesce(
            field("source_docs", "array<string>"), F.array().cast("array<string>")
        ).alias("source_docs"),
        F.coalesce(field("cache_hit", "boolean"), F.lit(False)).alias("cache_hit"),
        text("error"),
    )


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files as typed rows, with ``log_file, log_block, log_row`` giving the order of lines.

    Within a file split ``log_row`` rises with the line; splits of a file rise with
    ``log_block``. A multi-column sort on the three is the log order.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("log_file"),
        F.col("_metadata.file_block_start").alias("log_block"),
        F.monotonically_increasing_id().alias("log_row"),
    )
    return parse_log_lines(lines, LOG_ORDER)


def stream_request_log(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The growing log as a stream of typed rows, each with a ``log_id`` of its file and its text.

    Lines of a file that are equal in every character share it.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    place = F.concat_ws(
        ":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string"),
        F.md5("value"),
    )
    return parse_log_lines(lines.select("value", place.alias("log_id")), ("log_id",))


def log_events(requests: DataFrame) -> DataFrame:
    """Log rows as they are written: latency to 3 places, ISO-8601 UTC time."""
    stamp = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return requests.withColumns({"ts": stamp, "latency_ms": F.round("latency_ms", 3)}).select(
        *LOG_SCHEMA.fieldNames()
    )


def append_request_log(requests: DataFrame, path: str) -> None:
    """Append requests to a log folder, one JSON object per line."""
    log_events(requests).write.mode("append").option("ignoreNullFields", False).json(path)
