"""Stored vectors of texts, by what the texts say.

A store is a parquet table of text hash and vector below one folder for each model. A text that the store knows
is not embedded again, wherever it comes from, so that a growing corpus costs what is new in it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.operators.vectors import BATCH_SIZE, embed

_SCHEMA = "text_hash string, embedding array<double>"


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _folder(store: str, model: str) -> str:
    return f"{store.rstrip('/')}/model={model}"


def stored(spark: SparkSession, store: str, model: str) -> DataFrame:
    """The vectors of a model: text_hash, embedding. A store that is not there yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(store, model))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _SCHEMA)
    # two updates at a time may have stored a text twice
    return spark.read.schema(_SCHEMA).parquet(_folder(store, model)).dropDuplicates(["text_hash"])


def update(
    texts: DataFrame,
    store: str,
    model: str,
    make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    text: str = "text",
    batch_size: int = BATCH_SIZE,
) -> None:
    """Embed the texts that the store does not know, each once, and add them.

    Texts of like length go to the model together, which wastes least of a padded batch. NULL texts have no vector.
    """
    new = texts.filter(F.col(text).isNotNull()).select(text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    new = new.groupBy("text_hash").agg(F.min("text").alias("text"))  # copies meet before they are shuffled
    new = new.join(stored(texts.sparkSession, store, model).select("text_hash"), "text_hash", "left_anti")
    size = F.length("text")
    bucketed = new.repartitionByRange(size, "text_hash").sortWithinPartitions(size)
    embed(bucketed, make_predict_fn, batch_size=batch_size).select("text_hash", "embedding").write.mode("append").parquet(_folder(store, model))


def with_embeddings(texts: DataFrame, store: str, model: str, text: str = "text", output: str = "embedding") -> DataFrame:
    """*texts* with the stored vector of each, NULL where the store has none."""
    vectors = stored(texts.sparkSession, store, model).select(F.col("text_hash").alias("_hash"), F.col("embedding").alias(output))
    return texts.withColumn("_hash", text_hash(F.col(text))).join(vectors, "_hash", "left").drop("_hash")
