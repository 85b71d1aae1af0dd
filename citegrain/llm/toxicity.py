"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts have a model y each, of the class's own counts, with absolute discounts D of pairs and of contexts:

* p_y(w | h) = (1 - b(h)) * f_y(w | h) + b(h) * p_y(w), where f_y shares out what the discount leaves of the pairs of h,
  max(c_y(h, w) - D, 0), and b(h) is the mass that it frees. For the class with the fewer counts this is
  max(c - D, 0) / c(h) + freed / c(h) * p_y(w); both classes back off with that class's weight, or else what
  neither has seen would speak for the one with less data.
* p_y(w) is the same of contexts: k_y(w), the distinct words before w, in place of counts, and backs off to the word's stem.
* q_y(stem), of a stem's contexts (its first `STEM` letters), backs off to the contexts of the stem in both classes
  together. These, and g, the part of a stem's contexts that are the word's (one more is for words that are not
  known), are backoff counts that the classes share.

Each adds up to one over all words. An expression that the discount frees in both classes has the same backoff in both, so
what is rare says nothing; only what it leaves has to be kept. The evidence of a text is the log ratio of its two
likelihoods a word, the first feature. One toxic word hardly moves that in a long text, so the same ratio over the
`WINDOW` words where it is highest is a second one. A logistic curve over both, fitted on the training rows with each row's
own counts taken out (a pair that is not kept counts as the row's alone), makes the score.

Training rows are those whose CRC-32 of doc_id as text, modulo 4, is not 2, that have a label of
0 or 1 (the highest, if a doc_id has several), in the order of a hash of doc_id: of each class at most `max_rows`, and no
more once those before hold `max_bytes` of text. Spark counts them; what the discount leaves is collected and broadcast. That is
less than one entry of 24 bytes for every four words of these rows, at every size of the input. Words are known by 32 bits of
their hash.

Scores cover every row and whole texts of any length: null and empty texts have evidence 0; without rows of both classes
every text gets the share of toxic training rows (with one added to each class). Rows that repeat a
document are scored alike; equal scores stay equal. An empty table has no scores. Columns other than doc_id and text are
passed on or ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.plans.workdir import discard, written

#: The discounts of contexts and of pairs.
DISCOUNT, PAIR_DISCOUNT = 3, 8
STEM = 5
WINDOW = 3
MAX_ROWS = 10_000
MAX_BYTES = 32 << 20
THRESHOLD = 0.3
#: Words that a task remembers, which bounds its memory and not what is looked up.
REMEMBERED = 300_000
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEED = 42


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode().lower())


def code_of(word: bytes) -> int:
    """32 bits of a word's hash; 0 stands for the start of a text."""
    return xxhash.xxh32_intdigest(word, _SEED) or 1


def stem_of(word: bytes) -> bytes:
    return word.decode()[:STEM].encode()


def _at(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of *keys* in a sorted table, -1 for those that it does not have."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _sums(group: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.bincount(group, weights=values, minlength=n)


def _left_over(counts: np.ndarray, discount: int = DISCOUNT) -> np.ndarray:
    return np.maximum(counts - discount, 0)


def _freed(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The backoff weight of both classes: the larger part that the discount frees; all of it where a class has nothing."""
    return 1.0 - np.where(whole > 0, left / np.maximum(whole, 1), 0.0).min(axis=0)


def _shares(counts: np.ndarray, left: np.ndarray, discount: int = DISCOUNT) -> np.ndarray:
    return _left_over(counts, discount) / np.maximum(left, 1)


@dataclass
class Counts:
    """What the discount leaves, under sorted keys; numbers are of both classes (ordinary, toxic)."""

    pairs: np.ndarray  # left << 32 | word
    n: np.ndarray  # (2, pairs)
    lefts: np.ndarray
    c: np.ndarray  # (4, lefts): how often each comes before a word, and what is left of its pairs
    words: np.ndarray
    k: np.ndarray  # (3, words): contexts, and g
    stems: np.ndarray
    s: np.ndarray  # (2, stems)
    totals: np.ndarray  # (2, 3): contexts, what is left of the words', of the stems'

    def of_words(self, k: np.ndarray, g: np.ndarray, s: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """p_y(w) of both classes. Where a word is not kept (no contexts, g 1) only the ratio of the two is right."""
        m, of_words, of_stems = (x[:, None] for x in totals.T)
        both = s.sum(axis=0)
        shared = np.where(both > 0, both, 1) / (m.sum() + 1)
        b = _freed(of_stems, m)
        of_stem = (1 - b) * _shares(s, of_stems) + b * shared
        b = _freed(of_words, m)
        return (1 - b) * _shares(k, of_words) + b * of_stem * g

    def of_pairs(self, n: np.ndarray, c: np.ndarray, left: np.ndarray, of_word: np.ndarray) -> np.ndarray:
        """p_y(w | h) of both classes."""
        b = _freed(left, c)
        return (1 - b) * _shares(n, left, PAIR_DISCOUNT) + b * of_word

    def plain(self) -> tuple:
        """Arrays only: what is broadcast must not need this module to be read."""
        return self.pairs, self.n, self.lefts, self.c, self.words, self.k, self.stems, self.s, self.totals


def _picked(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Columns of *values*, 0 for place -1."""
    if not values.shape[1]:
        return np.zeros((len(values), len(at)))
    return np.where(at >= 0, values[:, at], 0.0)


def _words(counts: Counts, words: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, g and contexts of the stem for word and stem codes."""
    at = _at(counts.words, words)
    found = _picked(counts.k, at)
    return found[:2], np.where(at >= 0, found[2], 1.0), _picked(counts.s, _at(counts.stems, stems))


def _features(likelihoods: np.ndarray) -> tuple[float, float]:
    ratio = np.log(likelihoods[1] / likelihoods[0])
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    size = min(WINDOW, len(ratio))
    return float(ratio.mean()), float((sums[size:] - sums[:-size]).max() / size)


class Reader:
    """Evidence of texts by the counts; words are looked up once as long as they are remembered."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self.ids: dict[bytes, int] = {}
        #: For each remembered word: its p_y(w); as the word before, what `lefts` has of it; its code.
        self.facts = np.zeros((1024, 6))
        self.codes = np.zeros(1024, np.uint64)
        self._learn([b""])

    def _learn(self, new: list[bytes]) -> None:
        c, n = self.counts, len(self.ids)
        while n + len(new) > len(self.codes):
            self.facts, self.codes = np.concatenate([self.facts, np.zeros_like(self.facts)]), np.concatenate([self.codes, np.zeros_like(self.codes)])
        codes = np.array([code_of(w) if w else 0 for w in new], np.uint64)
        stems = np.array([code_of(stem_of(w)) if w else 0 for w in new], np.uint64)
        at = slice(n, n + len(new))
        self.codes[at] = codes
        self.facts[at] = np.concatenate([c.of_words(*_words(c, codes, stems), c.totals), _picked(c.c, _at(c.lefts, codes))]).T
        for i, w in enumerate(new):
            self.ids[w] = n + i

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """p_y(w | h) of both classes for every word of a text."""
        if len(self.ids) > REMEMBERED:
            self.__init__(self.counts)
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if new:
            self._learn(new)
        word = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        left = np.concatenate([[0], word[:-1]])
        n = _picked(self.counts.n, _at(self.counts.pairs, self.codes[left] << np.uint64(32) | self.codes[word]))
        own, before = self.facts[word].T, self.facts[left].T
        return self.counts.of_pairs(n, before[2:4], before[4:6], own[:2])

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Log ratio per word: of the whole text, of its worst window."""
        words = words_of(text)
        return _features(self.likelihoods(words)) if words else (0.0, 0.0)


def without_own(counts: Counts, text: str | None, y: int) -> tuple[float, float]:
    """The evidence of a training text of class *y* by the counts of all the others."""
    words = words_of(text)
    if not words:
        return 0.0, 0.0
    code = np.array([code_of(w) for w in words], np.uint64)
    stem = np.array([code_of(stem_of(w)) for w in words], np.uint64)
    left = np.concatenate([np.zeros(1, np.uint64), code[:-1]])
    pair, first, back, own = np.unique(left << np.uint64(32) | code, return_index=True, return_inverse=True, return_counts=True)
    n, c = _picked(counts.n, _at(counts.pairs, pair)), _picked(counts.c, _at(counts.lefts, left[first]))
    k, g, s = _words(counts, code[first], stem[first])
    gone = (n[y] <= own).astype(float)
    less = _left_over(n[y], PAIR_DISCOUNT) - _left_over(n[y] - own, PAIR_DISCOUNT)
    n[y] -= own
    totals = counts.totals.copy()
    totals[y, 0] -= gone.sum()

    def taken(values: np.ndarray, keys: np.ndarray, amount: np.ndarray) -> float:
        """Takes the sums of *amount* over equal keys out, and says how much less the discount leaves."""
        _, one, place = np.unique(keys, return_index=True, return_inverse=True)
        before = _left_over(values[one]).sum()
        values -= np.minimum(_sums(place, len(one), amount)[place], values)
        return before - _left_over(values[one]).sum()

    taken(c[y], left[first], own.astype(float))
    taken(c[2 + y], left[first], less)
    totals[y, 1] -= taken(k[y], code[first], gone)
    totals[y, 2] -= taken(s[y], stem[first], gone)
    return _features(counts.of_pairs(n, c[:2], c[2:], counts.of_words(k, g, s, totals))[:, back])


@dataclass
class Model:
    counts: Counts | None
    weights: np.ndarray | None  # intercept, whole text, worst window
    base: float
    shared: object = None  # the broadcast of the counts that fit made

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return _curve(self.weights, self.base, evidence)


def _curve(weights: np.ndarray | None, base: float, evidence: np.ndarray) -> np.ndarray:
    if weights is None:
        return np.full(len(evidence), base)
    return 1.0 / (1.0 + np.exp(-np.clip(weights[0] + evidence @ weights[1:], -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, toxic: the labelled documents that the models are made of, never held-out ones; written."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [known.filter(F.col("toxic") == c).orderBy(*order).limit(max_rows) for c in (0, 1)]
    ids = chosen[0].union(chosen[1])  # bounded by 2 * max_rows, so it may be broadcast
    sized = docs.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes")).join(F.broadcast(ids), "doc_id")
    # of rows that repeat a doc_id one counts
    one = sized.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.col("h"), "bytes")).alias("k")).select("doc_id", "toxic", "k.*")
    before = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    few = one.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).filter(F.col("before") < max_bytes)
    few = few.select("doc_id", "h", "toxic")  # a window of at most max_rows for each class
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(few), ["doc_id", "h"])
    return written(rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")))


def _listed(batches):
    """Sums of a batch's pairs (kind 0) by class, and its words with their stems (kind 1)."""
    for batch in batches:
        keys = {0: [np.zeros(0, np.uint64)], 1: [np.zeros(0, np.uint64)]}
        codes: dict[bytes, int] = {}
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            words = words_of(text.as_py())
            for w in words:
                if w not in codes:
                    codes[w] = code_of(w)
            own = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
            keys[toxic].append(np.concatenate([np.zeros(1, np.uint64), own])[: len(own)] << np.uint64(32) | own)
        for toxic, own in keys.items():
            pairs, n = np.unique(np.concatenate(own), return_counts=True)
            n = pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(pairs), np.int32)), pa.array(pairs.view(np.int64)), n[toxic], n[1 - toxic]], names=["kind", "key", "n0", "n1"]
            )
        stems = np.array([c << 32 | code_of(stem_of(w)) for w, c in codes.items()], np.uint64)
        none = pa.array(np.zeros(len(stems), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(stems), np.int32)), pa.array(stems.view(np.int64)), none, none], names=["kind", "key", "n0", "n1"])


def counted(rows: DataFrame) -> Counts:
    """The counts of training rows (text, toxic). What is collected is what the discount leaves, bounded with the rows."""
    listed = rows.select("text", "toxic").mapInArrow(_listed, "kind int, key bigint, n0 bigint, n1 bigint")
    sums = written(listed.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1")]))
    low, high = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("key", 32)
    over = lambda c, d=DISCOUNT: F.greatest(F.col(c) - d, F.lit(0))
    some = lambda *cs: F.greatest(*[F.col(c) for c in cs]) > (PAIR_DISCOUNT if cs[0] == "n0" else DISCOUNT)
    pairs = sums.filter("kind = 0").select("key", high.alias("left"), low.alias("word"), "n0", "n1")
    # should two words share 32 bits, the smaller stem is theirs
    stem = sums.filter("kind = 1").select(high.alias("word"), low.alias("stem")).groupBy("word").agg(F.min("stem").alias("stem"))
    words = pairs.groupBy("word").agg(
        *[F.count_if(F.col(f"n{y}") > 0).alias(f"k{y}") for y in (0, 1)], F.max(some("n0", "n1")).alias("in_pair")
    ).join(stem, "word")
    words = written(words)
    stems = words.groupBy("stem").agg(F.sum("k0").alias("s0"), F.sum("k1").alias("s1"), F.max("in_pair").alias("in_pair"))
    kept = words.filter(some("k0", "k1") | F.col("in_pair")).join(stems.select("stem", "s0", "s1"), "stem")
    g = (F.col("k0") + F.col("k1")) / (F.col("s0") + F.col("s1") + 1)
    lefts = pairs.groupBy("left").agg(*[F.sum(f"n{y}").alias(f"c{y}") for y in (0, 1)], *[F.sum(over(f"n{y}", PAIR_DISCOUNT)).alias(f"t{y}") for y in (0, 1)])

    def taken(table: DataFrame, key: str, values: list[str], kind: type) -> tuple[np.ndarray, np.ndarray]:
        found = table.select(key, *values).toArrow()
        keys = found.column(key).to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], np.stack([found.column(v).to_numpy().astype(kind)[order] for v in values])

    tables = (
        *taken(pairs.filter(some("n0", "n1")), "key", ["n0", "n1"], np.float32),
        *taken(lefts.filter("t0 > 0 and t1 > 0"), "left", ["c0", "c1", "t0", "t1"], np.float64),
        *taken(kept.withColumn("g", g), "word", ["k0", "k1", "g"], np.float64),
        *taken(stems.filter(some("s0", "s1") | F.col("in_pair")), "stem", ["s0", "s1"], np.float64),
    )
    of_words = words.agg(*[F.sum(c) for c in ("k0", "k1")], *[F.sum(over(c)) for c in ("k0", "k1")]).first()
    of_stems = stems.agg(*[F.sum(over(c)) for c in ("s0", "s1")]).first()
    totals = np.array([[of_words[y] or 0, of_words[2 + y] or 0, of_stems[y] or 0] for y in (0, 1)], float)
    discard(sums, words)
    return Counts(*tables, totals)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the slopes are held back a little."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    hold = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold, x.T @ (weight * (y - p)) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    spark = docs.sparkSession
    rows = training_rows(docs, labels, max_rows, max_bytes)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(None, None, (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2))
    counts = counted(rows)
    shared = spark.sparkContext.broadcast(counts.plain())

    def evidence(batches):
        known = Counts(*shared.value)
        for batch in batches:
            toxic = batch.column("toxic")
            pairs = [without_own(known, t.as_py(), y) for t, y in zip(batch.column("text"), toxic.to_pylist())]
            whole, worst = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([toxic, pa.array(whole, pa.float64()), pa.array(worst, pa.float64())], names=["toxic", "whole", "worst"])

    found = rows.select("toxic", "text").mapInArrow(evidence, "toxic int, whole double, worst double").toArrow()  # 2 * max_rows rows
    order = np.lexsort([found.column(n).to_numpy() for n in ("whole", "worst", "toxic")])
    y = found.column("toxic").to_numpy()[order].astype(float)
    x = np.column_stack([found.column(n).to_numpy()[order] for n in ("whole", "worst")])
    # the sample may hold other shares of the classes than all labelled training rows
    everyone = {r["toxic"]: r["count"] for r in labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("toxic").cast("int").alias("toxic")).count().collect()}
    weight = np.where(y == 1, everyone[1] / sizes[1], everyone[0] / sizes[0])
    discard(rows)
    return Model(counts, _fit(x, y, weight / weight.mean()), 0.0, shared)


def _scorer(docs: DataFrame, model: Model):
    """A function from batches and the place of the text column to each batch with its scores."""
    shared, weights, base = model.shared, model.weights, model.base

    def score(batches, text: int):
        reader = Reader(Counts(*shared.value)) if shared is not None else None
        for batch in batches:
            texts = batch.column(text)
            found = [reader.evidence(t.as_py()) for t in texts] if reader is not None else [(0.0, 0.0)] * len(texts)
            yield batch, _curve(weights, base, np.array(found, dtype=float).reshape(-1, 2))

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    score = _scorer(docs, model)

    def rows(batches):
        for batch, found in score(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    out = whole.mapInArrow(rows, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; texts are not shuffled."""
    score, text = _scorer(docs, model), docs.columns.index("text")

    def keep(batches):
        for batch, found in score(batches, text):
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(keep, docs.schema)
