"""The growing JSON-lines log, parsed tolerantly and landed as parquet by day."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citegrain.sources.request_log import stream_request_log

FILES_PER_DAY = 8


def ingest_request_log(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    available_now: bool = False,
) -> StreamingQuery:
    """Start a query that appends new log lines to a parquet table partitioned by ``day``.

    Later reads prune days and push filters down, which the text log cannot.
    """
    rows = stream_request_log(spark, source, files_per_batch).withColumn("day", F.to_date("ts"))
    # a day's rows of a batch go to a few tasks, so that it gets a few files and a busy day more than one task
    rows = rows.repartition(F.col("day"), F.pmod(F.xxhash64("log_id"), F.lit(FILES_PER_DAY)))
    writer = (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
