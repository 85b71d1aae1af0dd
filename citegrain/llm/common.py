"""Column expressions and small helpers that several of these operators share."""

from __future__ import annotations

import math
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of letters and digits: ASCII digits, a-z and everything beyond ASCII, after lower-casing A-Z.
NOT_LETTERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space, which separates the words of a size or of a shingle.
SPACES = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay. A text of ASCII only takes the fast built-in."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def letter_words(text: Column) -> Column:
    """Words of letters and digits in order; null has none."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(ascii_lower(text), NOT_LETTERS), "")


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}|{SPACES}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("bigint")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """*name*, made longer until no column of *df* has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


#: At most so many keys of a join are dealt over several tasks.
MOST_HOT = 1 << 16


def joined_to_one(rows: DataFrame, one: DataFrame, key: list[str], counts: DataFrame, total: int, how: str = "inner", least: int = 4096) -> DataFrame:
    """*rows* joined to the single row that *one* has for each key, with hot keys dealt over several tasks.

    *counts* has the key and `held`, its number of rows, and *total* is their sum, so at most `MOST_HOT` keys have more
    rows than a share; only their counts are broadcast. *how* is inner or left.
    """
    share = max(least, math.ceil(total / MOST_HOT))
    hot = counts.filter(F.col("held") > share).select(*key, F.ceil(F.col("held") / share).alias("deals"))
    if total <= share or not hot.take(1):
        return rows.join(one, key, how)
    hot = F.broadcast(hot)
    deals = F.coalesce("deals", F.lit(1).cast("bigint"))
    left = rows.join(hot, key, "left").withColumn("deal", F.pmod(F.xxhash64(*rows.columns), deals)).drop("deals")
    right = one.join(hot, key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), deals - 1))).drop("deals")
    return left.join(right, [*key, "deal"], how).drop("deal")


#: Bits of a mark table, which is broadcast: 8 MB at every size.
MARK_BITS = 1 << 26


def marks(keys: DataFrame, name: str, size: int = MARK_BITS) -> np.ndarray:
    """A table of *size* bits with one set for each key (a 64-bit hash): what is not marked is certainly no key."""
    bit = F.pmod(F.col(name), F.lit(size))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).alias("bits")
    found = keys.groupBy((bit / 64).cast("bigint").alias("word")).agg(word).toArrow()  # at most size / 64 rows
    table = np.zeros(size // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return table


def has_mark(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key, a signed number, may be one of those that *table* was made of."""
    bit = np.mod(keys, len(table) * 64)
    return (table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def marked(spark: SparkSession, table: np.ndarray, key: Column) -> Column:
    """Whether a key may be one of those that *table* was made of."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def look(keys: pd.Series) -> pd.Series:
        return pd.Series(has_mark(shared.value, keys.to_numpy().astype(np.int64)))

    return look(key)
