"""Lenient casts, guarded ratios and list measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrain.functions.text import _col, strip


# A full ISO date, or one with hours and minutes, seconds, a fraction and a zone as it likes.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2}){0,2})?)?$"


def _digits_joined(text: Column) -> Column:
    """Single underscores between digits are no part of a number."""
    return F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")


def lenient_int(c: Column | str) -> Column:
    """Whole-number text to bigint; anything else, or a missing cell, is 0."""
    text = _digits_joined(strip(_col(c).cast("string")))
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def lenient_float(c: Column | str) -> Column:
    """Decimal text to double; anything else, or a missing cell, is 0.0.

    A cast to double also reads Java's ``1d`` and ``1f``; those count as unparsable.
    """
    text = _digits_joined(strip(_col(c).cast("string")))
    parsed = F.when(~text.rlike(r"[0-9.][dDfF]$"), text.try_cast("double"))
    return F.coalesce(parsed, F.lit(0.0))


def lenient_timestamp(c: Column | str) -> Column:
    """Full ISO dates and date-times; what leaves out the date or a part of it is NULL.

    A cast alone reads ``12:30`` as today's, which would make a result depend on the day it is made.
    """
    text = F.replace(strip(_col(c).cast("string")), F.lit(","), F.lit("."))
    return F.when(text.rlike(ISO_TIME), text.try_cast("timestamp"))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0.0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def keyword_recall(answer: Column | str, keywords: Column | str) -> Column:
    """Share of the keywords (repeats count) found as substrings; none expected gives 0.0."""
    answer, keywords = _col(answer), _col(keywords)
    found = F.filter(keywords, lambda kw: F.contains(answer, kw))
    return ratio(F.size(found), F.nullif(F.size(keywords), F.lit(0)))


def any_keyword(answer: Column | str, keywords: Column | str) -> Column:
    answer = _col(answer)
    return F.coalesce(F.exists(_col(keywords), lambda kw: F.contains(answer, kw)), F.lit(False))


def non_empty_subset(part: Column, whole: Column) -> Column:
    """True when *part* holds something and all of it is in *whole*."""
    return (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")
