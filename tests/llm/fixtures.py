"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, H string, text_key int, shard string, rank int, fp int, words int, word int"


def words(seed: int, n: int, kinds: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(kinds)}" for _ in range(n))


def row(doc_id, text, source="s1", lang="en"):
    return doc_id, text, lang, source, len(text or ""), "x", 1, "y", 2, 3, 4, 5


def odd_rows() -> list[tuple]:
    """Every case that an operator must live with."""
    long = words(1, 3000)
    return [
        row(1, long), row(2, long), row(2, long), row(3, None), row(4, ""), row(5, " \n\t "), row(6, "one"),
        row(7, "one two"), row(None, words(2, 80)), row(8, words(2, 80), None), row(9, words(3, 120), None, None),
        row(10, words(4, 60) + " " + words(1, 70)), row(11, "Ümlaut ÄÖ İstanbul ß " + words(5, 30).upper()),
        row(12, words(6, 200), "s2"), row(13, words(6, 199) + " changed", "s2"), row(14, "\x00\x01 z", "s2"),
        row(15, "!!! ??? ...", "s3"), row(16, words(7, 64), "s3"), row(9, words(8, 40), "s3"),
    ]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
