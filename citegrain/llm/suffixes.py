"""Repeated passages by sparse suffix arrays.

Of the suffixes of all texts, word by word, only those are kept that start at an anchor: in every
window of `min_words` words the first position whose hash of the next `KEY` words is smallest. Windows with
equal words have equal anchors, so every passage of `min_words` words that two documents share
has an anchor at the same place in both, with `KEY` equal words behind it.

1. Suffixes are counted by those KEY words; only keys that two documents hold go on.
2. Those carry the `REACH` words before and behind the key (16 bits of each word's hash). Equal ones are
   folded, so a group of copies is one entry. Entries that two documents hold are repeats.
3. The other entries are sorted by key and what follows, and by key and what precedes, in ranges
   that split a crowded key; neighbours are compared and their match is extended left and right.
4. What no neighbour decides is decided by counting each of its windows of min_words words.

A document's matches become spans of words; they overlap into whole passages. Words are runs between
ASCII white space, A-Z lower. A repeat within one document is none. Null, empty and
shorter texts have no spans; rows that repeat a doc_id are one document, and null ids are one too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.common import free_name, has_mark, marks, same
from citegrain.plans.workdir import discard, written

MIN_WORDS = 50
REACH = 15
KEY = MIN_WORDS - REACH
SEED = 42
#: Repeated keys above this many bytes thin out the second pass by a table of bits of half that size, which lets some others pass.
BROADCAST_BYTES = 64 << 20
NO_ID = -(1 << 63)


def _words(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))


def _run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of *size* words: runs of powers of two, put together by the bits of size."""
    with np.errstate(over="ignore"):
        base, power, run, out, done = np.uint64(0x9E3779B97F4A7C15), 1, words, None, 0
        while True:
            if size & power:
                tail = run[done : done + len(words) - size + 1]
                out = tail if out is None else out * base + tail
                done += power
            if done == size:
                break
            run, base, power = run[: len(run) - power] * base + run[power:], base * base, power * 2
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors and the hashes of the KEY words there."""
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    keys = _run_hashes(words, KEY)
    windows = np.lib.stride_tricks.sliding_window_view(keys, REACH + 1)
    at = np.unique(np.arange(len(windows)) + windows.argmin(axis=1))
    return at, keys[at]


def _suffix_keys(batches):
    for batch in batches:
        ids, keys = [], []
        for doc_id, text in zip(batch.column("doc"), batch.column("text")):
            found = np.unique(anchors(_words(text.as_py()))[1])
            keys.append(found)
            ids.append(np.full(len(found), doc_id.as_py(), dtype=np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "doc"])


def _contexts(shared):
    names = ["doc", "at", "key", "before", "behind"]

    def carry(batches):
        known, bits = shared.value if shared is not None else (None, None)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc"), batch.column("text")):
                words = _words(text.as_py())
                at, keys = anchors(words)
                if known is not None and len(at):
                    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    kept = known[place] == keys
                    at, keys = at[kept], keys[kept]
                elif bits is not None and len(at):
                    kept = has_mark(bits, keys.view(np.int64))
                    at, keys = at[kept], keys[kept]
                if not len(at):
                    continue
                short, doc_id = (words >> np.uint64(48)).astype("<u2"), doc_id.as_py()
                turned = short[::-1]
                for i, key in zip(at.tolist(), keys.view(np.int64).tolist()):
                    back = len(words) - i
                    row = doc_id, i, key, turned[back : back + REACH].tobytes(), short[i + KEY : i + KEY + REACH].tobytes()
                    for column, value in zip(rows, row):
                        column.append(value)
            if rows[0]:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return carry


def _common(a: bytes, b: bytes) -> int:
    """How many words two runs of word hashes have in common from their start."""
    n = min(len(a), len(b)) // 2
    for i in range(n):
        if a[2 * i : 2 * i + 2] != b[2 * i : 2 * i + 2]:
            return i
    return n


_ENTRY = "key bigint, before binary, behind binary, low bigint, high bigint"
_MATCH = f"{_ENTRY}, left int, right int, other bigint, edge boolean"


def _neighbours(batches):
    """Each entry with its best match among the two next to it; the first and last also as edges."""
    schema = pa.schema([
        ("key", pa.int64()), ("before", pa.binary()), ("behind", pa.binary()), ("low", pa.int64()), ("high", pa.int64()),
        ("left", pa.int32()), ("right", pa.int32()), ("other", pa.int64()), ("edge", pa.bool_()),
    ])

    def match(a, b):
        return _common(a["before"], b["before"]), _common(a["behind"], b["behind"])

    held, out, first = None, [], True
    for batch in batches:
        for row in batch.to_pylist():
            row |= {"left": 0, "right": 0, "other": None, "edge": first}
            first = False
            if held is not None:
                if held["key"] == row["key"] and (held["low"], held["high"]) != (row["low"], row["high"]) or held["key"] == row["key"] and held["low"] != held["high"]:
                    left, right = match(held, row)
                    for own, near in ((held, row), (row, held)):
                        if left + right > own["left"] + own["right"] or own["other"] is None:
                            own |= {"left": left, "right": right, "other": near["low"] if near["low"] != own["low"] else near["high"]}
                out.append(held)
            held = row
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if held is not None:
        held["edge"] = True
        out.append(held)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _compared(entries: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Entries matched with their neighbours in this order, all over the ranges they are sorted in; and the table behind."""
    size = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(size, *order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_neighbours, _MATCH))
    # two edges for each range: few enough to be put in order by one task
    edges = found.filter("edge").select("key", "before", "behind", "low", "high").distinct()
    edges = edges.coalesce(1).sortWithinPartitions(*order).mapInArrow(_neighbours, _MATCH)
    return found.union(edges).select("key", "before", "behind", "left", "right", "other"), found


def _repeats(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that lie in a shared passage: key, before, behind, left, right (words it reaches), other; and a table behind."""
    sure = entries.filter("low <> high").select(
        "key", "before", "behind", (F.octet_length("before") / 2).cast("int").alias("left"),
        (F.octet_length("behind") / 2).cast("int").alias("right"), F.lit(None).cast("bigint").alias("other"),
    )
    (behind, first), (before, second) = _compared(entries, "key", "behind", "before"), _compared(entries, "key", "before", "behind")
    matched = behind.union(before)
    best = F.max(F.struct((F.col("left") + F.col("right")).alias("n"), "left", "right", "other")).alias("m")
    best = matched.filter("other is not null").groupBy("key", "before", "behind").agg(best)
    near = best.filter(F.col("m.n") >= REACH).select("key", "before", "behind", "m.left", "m.right", "m.other")
    decided = written(sure.union(near))
    discard(first, second)

    open_ = entries.join(decided.select("key", "before", "behind"), ["key", "before", "behind"], "left_anti")
    # a key that only two entries hold was decided when they were neighbours
    crowded = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 2").select("key")
    open_keys = open_.select("key").distinct().join(crowded, "key", "left_semi")
    windows = entries.join(open_keys, "key", "left_semi").withColumn("left", F.explode(F.sequence(F.lit(0), F.lit(REACH))))
    windows = windows.withColumn("right", REACH - F.col("left"))
    windows = windows.filter((F.octet_length("before") >= 2 * F.col("left")) & (F.octet_length("behind") >= 2 * F.col("right")))
    part = F.xxhash64("key", "left", F.substring("before", F.lit(1), 2 * F.col("left")), F.substring("behind", F.lit(1), 2 * F.col("right")))
    windows = windows.withColumn("window", part)
    held = windows.groupBy("window").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h")
    more = windows.join(held, "window").groupBy("key", "before", "behind").agg(
        F.max("left").alias("left"), F.max("right").alias("right"), F.min("l").alias("l"), F.max("h").alias("h"), F.min("low").alias("low")
    )
    more = more.select("key", "before", "behind", "left", "right", F.when(F.col("l") != F.col("low"), F.col("l")).otherwise(F.col("h")).alias("other"))
    more = more.join(decided.select("key", "before", "behind"), ["key", "before", "behind"], "left_anti")
    whole = decided.union(more).groupBy("key", "before", "behind")
    return whole.agg(F.max("left").alias("left"), F.max("right").alias("right"), F.min("other").alias("other")), decided


def repeated_spans(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document and passage that another document holds too: doc_id, start, n_words, other_id
    (one that does). Spans of a document are disjoint; each is a union of shared passages."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), "text")
    keys = rows.mapInArrow(_suffix_keys, "key bigint, doc bigint")
    shared_keys = written(keys.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high").select("key"))
    shared = None
    if shared_keys.count() * 8 <= broadcast_bytes:
        known = np.sort(shared_keys.toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))
        if not len(known):
            empty = docs.select("doc_id").schema.add("start", "long").add("n_words", "long").add("other_id", "long")
            return spark.createDataFrame([], empty)
        shared = spark.sparkContext.broadcast((known, None))
    elif broadcast_bytes >= 16:
        shared = spark.sparkContext.broadcast((None, marks(shared_keys, "key", 4 * (1 << broadcast_bytes.bit_length() - 1))))
    discard(shared_keys)
    contexts = rows.mapInArrow(_contexts(shared), "doc bigint, at bigint, key bigint, before binary, behind binary")
    # a passage is found again by two hashes, which are fewer bytes to shuffle than its words
    found = written(contexts.withColumn("entry", F.xxhash64("key", "before", "behind")))
    entries = written(found.groupBy("key", "before", "behind").agg(F.min("doc").alias("low"), F.max("doc").alias("high")))
    # written, so that a crowded entry's rows can be split among tasks when they meet it
    reached, decided = _repeats(entries)
    repeats = reached.join(entries, ["key", "before", "behind"]).withColumn("entry", F.xxhash64("key", "before", "behind"))
    repeats = written(repeats.select("key", "entry", "left", "right", "other", "low", "high"))
    del reached
    discard(entries, decided)
    other = F.coalesce(F.when(F.col("low") != F.col("doc"), F.col("low")), F.when(F.col("high") != F.col("doc"), F.col("high")), F.col("other"))
    spans = found.select("doc", "at", "key", "entry").join(repeats.hint("merge"), ["key", "entry"]).select(
        "doc", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + KEY + F.col("right")).alias("end"), other.alias("other")
    )
    spans = spans.groupBy("doc", "start").agg(F.max("end").alias("end"), F.min("other").alias("other"))
    order = Window.partitionBy("doc").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    spans = spans.withColumn("span", F.sum("opens").over(order)).groupBy("doc", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")
    )
    kind = docs.schema["doc_id"].dataType
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)
    return spans.select(id_of("doc").alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("n_words"), id_of("other").alias("other_id"))


def _windows(batches):
    """Hashes of the windows of MIN_WORDS words inside each row's spans."""
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        for i, text in enumerate(batch.column("text")):
            words = _words(text.as_py())
            hashes = _run_hashes(words, MIN_WORDS) if len(words) >= MIN_WORDS else words[:0]
            at = [np.arange(s["start"], min(s["end"] - MIN_WORDS + 1, len(hashes))) for s in spans[i]]
            at = np.concatenate(at).astype(np.int64)
            columns = [pa.array([batch.column(c)[i].as_py()] * len(at), batch.schema.field(c).type) for c in ("doc", "text_key")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(hashes[at].view(np.int64))], names=["doc", "text_key", "start", "window"])


def without_repeats(docs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """The documents, each passage cut out wherever a document of smaller id holds it too.

    Cut are the words of every window of min_words words inside a span whose smallest holder is another
    document, whichever neighbour the span names. Null ids cut nothing and are not cut. The words before
    and behind keep their white space.
    """
    spans = repeated_spans(docs) if spans is None else spans
    cuts, key, text_key = (free_name(docs, x) for x in ("cuts", "cut_id", "text_key"))
    places = spans.filter("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(
        F.collect_list(F.struct("start", (F.col("start") + F.col("n_words")).alias("end"))).alias("spans")
    )
    texts = docs.select(F.col("doc_id").alias("doc"), "text", F.xxhash64("text").alias("text_key")).join(places, "doc")
    kind = docs.schema["doc_id"].dataType.simpleString()
    windows = written(texts.mapInArrow(_windows, f"doc {kind}, text_key bigint, start bigint, window bigint"))
    holders = windows.groupBy("window").agg(F.min("doc").alias("first"))
    later = windows.join(holders, "window").filter("first < doc").select("doc", "text_key", "start").distinct()
    order = Window.partitionBy("doc", "text_key").orderBy("start")
    opens = F.when(F.col("start") <= F.lag("start").over(order) + MIN_WORDS, 0).otherwise(1)
    later = later.withColumn("opens", opens).withColumn("cut", F.sum("opens").over(order))
    later = later.groupBy("doc", "text_key", "cut").agg(F.min("start").alias("start"), (F.max("start") + MIN_WORDS).alias("end"))
    later = later.groupBy(F.col("doc").alias(key), F.col("text_key").alias(text_key)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    rows = docs.join(later, same(docs["doc_id"], later[key]) & (F.xxhash64(docs["text"]) == later[text_key]), "left")
    return rows.withColumn("text", _cut(F.col("text"), F.col(cuts))).select(*docs.columns)


def _cut(text: Column, cuts: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(cuts, lambda s: (i >= s["start"]) & (i < s["end"])))
    return F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), F.regexp_extract(text, r"([\x20\x09-\x0D]*)\z", 1)))
