"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="citegrain-")


def shared_dir(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the application ends.

    Only a session whose tasks run in the driver may go without that setting; a cluster session
    must name a folder that every executor can reach.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_base()
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _delete_at_end(spark, path)
    if not spark.conf.get("spark.checkpoint.dir", None):
        _delete_at_end(spark, base)
    return path


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """The file system forgets the path when the driver's JVM shuts down."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage through a parquet table in the shared folder."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: all that came of them is collected or written itself.

    The driver then forgets the jobs behind them, as Spark's own cleaner makes it do from time to time: their shuffles
    and broadcasts go, and an operator of many steps does not fill the driver with plans.
    """
    for table in tables:
        spark = table.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if re.fullmatch("[0-9a-f]{32}", folder.rsplit("/", 1)[-1]):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()
