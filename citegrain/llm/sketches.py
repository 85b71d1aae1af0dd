"""Document fingerprints: threshold-scaled sketches.

A sketch keeps the hash of every run of `SHINGLE` code points that falls below a fixed fraction
(one in `SCALE`) of the hash range, so it grows with the text and two sketches are comparable
however unequal their texts: the sketch of two texts' shingles together is the union of theirs.
A text that keeps none by that rule keeps its smallest hash instead, which lies above the fraction: it tells equal texts
from others, but is no part of another text's sketch and leaves a union with one. A text shorter than a run is one run; the
empty text has the empty sketch. Equal texts have equal sketches. As a fingerprint a sketch is its sorted
hashes, eight hex digits each.

Likeness is the share of common hashes in all hashes of two sketches, 1 for two empty ones;
containment is the share of the first one's hashes that the second has, and unknown (null) where the first has
none below the fraction but the second one has.

`with_neighbours` compares each text with an edited one and with the next document, in ascending
order of doc_id (nulls first, rows that repeat an id by a hash of their text). Texts are shuffled
once, in ranges of that order; the first row of each range also goes to the end of the range before. Rows that
repeat id and text in great number are folded to one with a count. Ids may be numbers or strings.
Null texts count as empty; texts of any length are hashed whole, in blocks. A single document is its own next one. An
empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citegrain.llm.common import same

SHINGLE = 16  # a power of two
SCALE = 32
#: Code points hashed at once, which bounds a very long text's memory.
BLOCK = 1 << 20
#: UTF-8 bytes of text that a range of doc_ids is meant to hold, and the most ranges there may be.
RANGE_BYTES = 4 << 20
MAX_RANGES = 200_000
#: Rows sampled for each range's end.
SAMPLED = 20
#: More rows than this that repeat id and text are folded to one.
REPEATS = 1000


def _mixed(x: np.ndarray) -> np.ndarray:
    """32 well-spread bits of each 64-bit number."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)).astype(np.uint32)


def _shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of every run of SHINGLE numbers, by doubling runs; of all, if there are fewer."""
    with np.errstate(over="ignore"):
        h, base = codes + np.uint64(1), np.uint64(0x100000001B3)
        if len(codes) < SHINGLE:
            whole = np.uint64(len(codes))
            for c in h:
                whole = whole * base + c
            return _mixed(np.array([whole], dtype=np.uint64))
        size = 1
        while size < SHINGLE:
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2
        return _mixed(h)


def sketch(text: str) -> np.ndarray:
    """The kept hashes, sorted and distinct."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if not len(codes):
        return np.zeros(0, dtype=np.uint32)
    limit, kept, least = np.uint32((1 << 32) // SCALE), [], None
    for at in range(0, max(1, len(codes) - SHINGLE + 1), BLOCK):
        h = _shingle_hashes(codes[at : at + BLOCK + SHINGLE - 1].astype(np.uint64))
        kept.append(h[h < limit])
        least = h.min() if least is None else min(least, h.min())
    found = np.unique(np.concatenate(kept))
    return found if len(found) else np.array([least], dtype=np.uint32)


def _scaled(found: np.ndarray) -> bool:
    """Whether a sketch holds hashes below the fraction, and not the smallest of all for want of one."""
    return len(found) > 0 and found[0] < (1 << 32) // SCALE


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    if _scaled(a) == _scaled(b):
        both = np.union1d(a, b)
        return both if _scaled(a) else both[:1]
    return a if _scaled(a) else b


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float | None]:
    """Common hashes of all hashes, and of the first one's."""
    if not len(a) and not len(b):
        return 1.0, 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    alike = both / (len(a) + len(b) - both)
    if not len(a):
        return alike, 1.0
    return alike, None if _scaled(b) and not _scaled(a) else both / len(a)


def fingerprint(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


_COLUMNS = {
    "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "kept_edited": pa.float64(), "kept_next": pa.float64(),
}


def _compared(doc_id, text: str, own: np.ndarray, after: str, after_sketch: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = sketch(edited)
    (near_edited, kept_edited), (near_next, kept_next) = likeness(own, changed), likeness(own, after_sketch)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(changed),
        near_edited, near_next, kept_edited, kept_next,
    )


def _rows(id_type: pa.DataType):
    def batch_of(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * (2 + len(_COLUMNS))
        types = [id_type, *_COLUMNS.values(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", *_COLUMNS, "n"])

    def compare(batches):
        waiting = None  # the row whose next one has not come yet
        for batch in batches:
            done = []
            columns = (batch.column(c) for c in ("part", "guest", "doc_id", "n", "text"))
            for part, guest, doc_id, n, text in zip(*columns):
                part, guest, doc_id, n, text = part.as_py(), guest.as_py(), doc_id.as_py(), n.as_py(), text.as_py() or ""
                if guest and (waiting is None or waiting[0] != part):
                    continue
                own = sketch(text)
                if waiting is not None and waiting[0] == part:
                    done.append((*_compared(*waiting[1:], text, own), 1))
                if not guest and n > 1:  # all but the last of equal rows have an equal one next
                    done.append((*_compared(doc_id, text, own, text, own), n - 1))
                waiting = None if guest else (part, doc_id, text, own)
            if done:
                yield batch_of(done)

    return compare


def _order_key(doc_id, h: int) -> tuple:
    if doc_id is None:
        return 0, 0, h
    return 1, doc_id.encode() if isinstance(doc_id, str) else doc_id, h


def _in_ranges(docs: DataFrame, range_bytes: int) -> DataFrame:
    """Rows with a range of the order (part) and a count (n), each range's first row also behind the range before (guest)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).withColumn("n", F.lit(1).cast("bigint"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    few = max(REPEATS, total[1] // 50_000)  # so at most 50,000 ids with a text have more rows than this
    hot = rows.groupBy("doc_id", "h").agg(F.count("*").alias("held")).filter(F.col("held") > few)
    hot = hot.select(F.col("doc_id").alias("hot_id"), F.col("h").alias("hot_h"))
    if hot.take(1):
        on = same(F.col("doc_id"), F.col("hot_id")) & (F.col("h") == F.col("hot_h"))
        folded = rows.join(F.broadcast(hot), on, "left_semi").groupBy("doc_id", "h").agg(F.max("text").alias("text"), F.sum("n").alias("n"))
        rows = rows.join(F.broadcast(hot), on, "left_anti").unionByName(folded)
    n = int(min(MAX_RANGES, max(1, total[0] // range_bytes, total[1] // 100_000)))
    cuts = []
    if n > 1:
        one_in = max(1, total[1] // (SAMPLED * n))
        sampled = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct()
        sampled = sampled.filter(F.pmod(F.xxhash64("h", "doc_id"), F.lit(one_in)) == 0)
        keys = sorted(_order_key(r["doc_id"], r["h"]) for r in sampled.collect())  # about SAMPLED * n rows
        cuts = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    shared = spark.sparkContext.broadcast(cuts)
    whole = docs.schema["doc_id"].dataType.simpleString() != "string"

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        ids = [None if pd.isna(i) else int(i) if whole and float(i).is_integer() else i for i in ids]
        return pd.Series([bisect.bisect_right(shared.value, _order_key(i, h)) for i, h in zip(ids, hashes.tolist())], dtype="int32")

    ranged = rows.withColumn("part", part_of("doc_id", "h"))
    ids = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")
    firsts = ranged.groupBy("part").agg(F.min(ids).alias("k")).select("part", "k.doc_id", "k.h").orderBy("part").collect()
    parts = [r["part"] for r in firsts]  # at most MAX_RANGES
    before = [(r["part"], r["doc_id"], r["h"], parts[i - 1]) for i, r in enumerate(firsts)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = spark.createDataFrame(before, f"first_part int, first_id {kind}, first_h bigint, before int")
    on = (F.col("part") == F.col("first_part")) & same(F.col("doc_id"), F.col("first_id")) & (F.col("h") == F.col("first_h"))
    places = F.array_compact(F.array(
        F.struct(F.col("part"), F.lit(0).alias("guest")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest"))),
    ))
    marked = ranged.join(F.broadcast(first), on, "left").select("doc_id", "text", "h", "n", F.explode(places).alias("place"))
    placed = marked.select("place.part", "place.guest", "doc_id", "h", "n", "text")
    return placed.repartition(max(1, len(parts) // 3), "part").sortWithinPartitions("part", "guest", "doc_id", "h")


def with_neighbours(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (likeness), kept_edited, kept_next (containment).

    The edited text is the text with its last n_chars // 2 code points replaced by the first as many
    (or all) of the next document.
    """
    schema = docs.select("doc_id").schema
    for name, kind in _COLUMNS.items():
        schema = schema.add(name, {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}[kind])
    compare = _rows(to_arrow_type(docs.schema["doc_id"].dataType))
    rows = _in_ranges(docs, range_bytes).select("part", "guest", "doc_id", "n", "text").mapInArrow(compare, schema.add("n", "long"))
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("n")
