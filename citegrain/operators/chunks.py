"""Documents to chunks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import strip


def paragraph_chunks(documents: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Paragraphs of each ``(doc_name, text)``, stripped, blank ones dropped, numbered from 0."""
    # the pattern is the separator's characters, each quoted
    pattern = "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in separator)
    parts = F.filter(F.transform(F.split("text", pattern), strip), lambda p: p != "")
    return documents.select("doc_name", F.posexplode(parts).alias("chunk_id", "text"))


def sliding_chunks(documents: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Windows of *size* characters of each ``(doc_name, text)``, each beginning *overlap* before the last one's end.

    Rows doc_name, chunk_id (from 0), chunk_start, chunk_end (characters, end excluded) and text, a slice of the source
    that splits no character. The last window ends with the text, which a window reaches before another begins. Empty
    and NULL texts have no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in 0..size - 1")
    step = size - overlap
    piece = math.gcd(size, step)  # a text is cut once, and windows are runs of the pieces
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}+"), F.lit(0))
    n = F.length("text")
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0))
    cut = documents.filter(n > 0).select("doc_name", n.alias("n"), pieces.alias("pieces"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    start = F.col("chunk") * step
    return cut.select(
        "doc_name",
        F.col("chunk").cast("int").alias("chunk_id"),
        start.alias("chunk_start"),
        F.least(start + size, F.col("n").cast("bigint")).alias("chunk_end"),
        F.array_join(F.slice("pieces", (start / piece + 1).cast("int"), F.lit(size // piece)), "").alias("text"),
    )


def corpus_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunk_count"), F.countDistinct("doc_name").alias("doc_count")
    )
