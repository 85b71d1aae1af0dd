"""Benchmark decontamination: the windows of benchmark items found in documents.

A benchmark item gives one window for each run of `window` consecutive words; a shorter item
that has words is one window as a whole. Windows are normalised (A-Z lower, words of letters
and digits). Document windows are looked up by hash in a broadcast set, and what is found
there is compared word by word. A document word inside any such window is hit.

Null texts, and texts without words, have no windows and are never hit; a null item id counts
as no item. Rows that repeat a document are judged alike, each for itself, and searched for hits once.
Texts of any length are searched whole. Empty tables give no rows, an empty benchmark hits nothing. Columns of the
documents other than doc_id and text pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.common import free_name, letter_words, same
from citegrain.plans.workdir import written

WINDOW = 10
#: Above this many bytes of windows the lookup is a shuffled join instead of a broadcast.
BROADCAST_BYTES = 64 << 20


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per item and distinct window: item_id, gram (its words)."""
    words = benchmark.select("item_id", letter_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = words.select("item_id", "words", length.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at"))
    return starts.select("item_id", F.slice("words", F.col("at") + 1, F.col("n")).alias("gram")).distinct()


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, windows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Where windows occur: doc_id, text_key, at (word position from 0), gram; once for rows that repeat a document.

    The set of window hashes is broadcast if the windows' words hold at most *broadcast_bytes*; otherwise both
    lookups are shuffled joins of hashes, and only texts with a hit are read again.
    """
    grams = windows.select("gram").distinct().select(F.xxhash64("gram").alias("h"), "gram")
    size = grams.agg(
        F.coalesce(F.sum(F.octet_length(F.array_join("gram", " ")) + 64), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set(F.size("gram"))).alias("lengths"),
    ).first()
    lengths = size["lengths"]  # at most as many as a window has words
    words = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), letter_words(F.col("text")).alias("words"))
    n = F.lit(lengths[0] if lengths else WINDOW)
    if len(lengths) > 1:
        words = words.withColumn("n", F.explode(F.array(*[F.lit(x) for x in lengths])))
        n = F.col("n")
    starts = words.filter(F.size("words") >= n).select(
        "doc_id", "text_key", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at")
    )
    gram, hashes = F.slice("words", F.col("at") + 1, F.col("n")), grams.select("h").distinct()
    if size["bytes"] <= broadcast_bytes:
        cut = starts.select("doc_id", "text_key", "at", F.xxhash64(gram).alias("h"), gram.alias("gram"))
        maybe = cut.join(F.broadcast(hashes), "h", "left_semi")
        return maybe.join(F.broadcast(grams), ["h", "gram"]).select("doc_id", "text_key", "at", "gram").distinct()
    # windows are shuffled without their words, and those with a known hash are cut out of their texts again
    cut = starts.select("doc_id", "text_key", "at", "n", F.xxhash64(gram).alias("h"))
    maybe = written(cut.join(hashes.hint("merge"), "h", "left_semi").distinct())
    of = maybe.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "at", "n", "h")
    texts = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), "text")
    ids = of.select("of_id", "of_key").distinct()
    on = same(F.col("doc_id"), F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    texts = texts.join(ids, on, "left_semi").groupBy("doc_id", "text_key").agg(F.max("text").alias("text"))
    texts = texts.select("doc_id", "text_key", letter_words(F.col("text")).alias("words"))
    found = texts.join(of, on).select("doc_id", "text_key", "at", "h", gram.alias("gram"))
    return found.join(grams.hint("merge"), ["h", "gram"]).select("doc_id", "text_key", "at", "gram")


def spans(found: DataFrame) -> DataFrame:
    """The union of the occurrences: doc_id, text_key, start, end (words, end excluded), disjoint."""
    rows = found.select("doc_id", "text_key", F.col("at").alias("start"), (F.col("at") + F.size("gram")).alias("end"))
    text = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    before = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    numbered = rows.withColumn("opens", opens).withColumn("span", F.sum("opens").over(text))
    return numbered.groupBy("doc_id", "text_key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("span")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items (sorted), contaminated."""
    windows = benchmark_windows(benchmark, window)
    found = written(occurrences(docs, windows))
    hit = spans(found).groupBy("doc_id", "text_key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    of_items = (
        found.select("doc_id", "text_key", "gram").distinct()
        .join(windows.filter(F.col("item_id").isNotNull()), "gram")
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    hit, of_items = hit.alias("h"), of_items.alias("i")
    d = docs.select(
        "doc_id", _text_key(F.col("text")).alias("text_key"), F.size(letter_words(F.col("text"))).cast("bigint").alias("n_words")
    ).alias("d")
    on = lambda other: same(F.col("d.doc_id"), F.col(f"{other}.doc_id")) & (F.col("d.text_key") == F.col(f"{other}.text_key"))
    items = F.coalesce("i.items", F.array().cast("array<string>"))
    n_hit = F.coalesce("h.n_hit", F.lit(0)).cast("bigint")
    return d.join(hit, on("h"), "left").join(of_items, on("i"), "left").select(
        "d.doc_id", "d.n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        items.alias("items"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    key = free_name(docs, "text_key")
    hit = occurrences(docs, benchmark_windows(benchmark, window)).select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")
    ).distinct()
    kept = docs.withColumn(key, _text_key(F.col("text")))
    return kept.join(hit, same(kept["doc_id"], hit["hit_id"]) & (kept[key] == hit["hit_key"]), "left_anti").drop(key)


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, their hit words (and what stands before each) cut out of the text."""
    key, cuts, hit_id, hit_key = (free_name(docs, x) for x in ("text_key", "cuts", "hit_id", "hit_key"))
    cut = spans(occurrences(docs, benchmark_windows(benchmark, window))).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "end")).alias(cuts)
    ).select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key), cuts)
    rows = docs.withColumn(key, _text_key(F.col("text")))
    rows = rows.join(cut, same(rows["doc_id"], cut[hit_id]) & (rows[key] == cut[hit_key]), "left")
    gap, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all("text", F.lit(f"{gap}*{word}+"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(cuts, lambda s: (i >= s["start"]) & (i < s["end"])))
    tail = F.regexp_extract("text", f"({gap}*)\\z", 1)
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return rows.withColumn("text", text).select(*docs.columns)
