"""Embedding, normalization and exact vector retrieval."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.functions.text import preview, tokens
from citegrain.plans.block_topk import MAX_BROADCAST_QUESTIONS, MAX_HELD_HITS, blocked_top_k, with_attached

# Defaults for embedding and retrieval, and the confidence thresholds.
BATCH_SIZE = 32
TOP_K = 3
MAX_TOP_K = 20
PREVIEW_CHARS = 220
HIGH_SCORE = 0.75
MEDIUM_SCORE = 0.55


def embed(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    text: str = "text",
    output: str = "embedding",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Embed a text column with a user's model, *batch_size* texts a call, then normalize.

    *make_predict_fn* loads the model once per Python worker and returns a function from an
    array of texts to a matrix of vectors.
    """
    def make_unit_fn():
        predict = make_predict_fn()

        def unit(texts: np.ndarray) -> np.ndarray:
            vectors = np.asarray(predict(texts), dtype=np.float64)
            lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            return vectors / np.where(lengths == 0, 1.0, lengths)

        return unit

    model = predict_batch_udf(make_unit_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.withColumn(output, model(F.col(text)))


def hashed_embedding(
    df: DataFrame, text: str = "text", output: str = "embedding", dimensions: int = 256
) -> DataFrame:
    """Model-free embedding: token counts hashed to buckets, scaled to unit length."""
    counted = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dimensions)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    vectors = unit.transform(counted.transform(df.withColumn("_tokens", tokens(text))))
    return vectors.withColumn(output, vector_to_array("_unit", "float32")).drop(
        "_tokens", "_counts", "_unit"
    )


def normalized(vector: Column) -> Column:
    """Scaled to unit length; a zero vector stays as it is."""
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    # bound as the one element of an array, so that the length is computed once and not per element
    lengths = F.array(F.when(squares == 0, 1.0).otherwise(F.sqrt(squares)))
    return F.get(F.transform(lengths, lambda n: F.transform(vector, lambda x: x.cast("double") / n)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _check_top_k(k: int, limit: int | None = None) -> None:
    if k <= 0:
        raise ValueError("top_k must be > 0")
    if limit is not None and k > limit:
        raise ValueError(f"top_k must be <= {limit}")


def checked_questions(questions: DataFrame, top_k: int, query: str = "query") -> DataFrame:
    """Request bounds: top_k in 1..20, empty queries are left out."""
    _check_top_k(top_k, MAX_TOP_K)
    return questions.filter(F.length(query) >= 1)


def search(index: DataFrame, vector: Sequence[float], top_k: int = TOP_K, carry: Sequence[str] = ()) -> DataFrame:
    """The best chunks for one query vector, which is normalized first."""
    _check_top_k(top_k)
    query = np.asarray(vector, dtype=float)
    length = float(np.sqrt((query * query).sum()))
    unit = [float(x) / length if length else float(x) for x in query]
    question = index.sparkSession.createDataFrame([(0, unit)], "qid int, embedding array<double>")
    hits = top_k_chunks(question, index, top_k, attach=carry)
    return hits.orderBy("rank").select("doc_name", "chunk_id", "score", *carry)


def _rows_as_matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; a null number counts as NaN, and all must be of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    width = width if width is not None else int(lengths[0]) if len(lengths) else 0
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} numbers meet some of {sorted(set(lengths.tolist()) - {width})[:3]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width)


# questions and items of one matrix product: its scores stay in a core's cache
QUESTION_TILE, ITEM_TILE = 512, 1024
# candidates gathered before they are scored again
MAX_CANDIDATES = 4_000_000


def _first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that k rows before equal."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    sorted_group = group[by_group]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    place = np.arange(len(by_group)) - np.repeat(starts, np.diff(np.r_[starts, len(by_group)]))
    return np.sort(by_group[place < k])


def dot_scorer(questions: pa.Table) -> Callable:
    """Dot products a block at a time.

    A matrix product, in single precision unless numbers are too large for it, finds the candidates: all scores that
    may reach the floor, or while there is none the k-th best of the block. Its rounding error is at most the margin;
    candidates are scored again row by row in double precision, which makes scores, and hence ties, independent of how
    rows were batched.
    """
    asked = _rows_as_matrix(questions["embedding"])
    width = asked.shape[1]
    lengths = np.sqrt((asked * asked).sum(axis=1))

    def best(items: pa.Table, k: int, floor: np.ndarray):
        vectors = _rows_as_matrix(items["embedding"], width)
        usable = np.flatnonzero(~np.isnan(vectors).any(axis=1))
        vectors = vectors[usable]
        if not len(vectors) or not width:
            return
        # of equal vectors only the first k rows can be among the k best
        rows = _first_copies(vectors, k)
        vectors = vectors[rows]

        with np.errstate(over="ignore", invalid="ignore"):
            longest = np.sqrt((vectors * vectors).sum(axis=1).max())
            # a longest sum of squares within single precision leaves every product and sum there, too
            plain = bool(np.nanmax(np.r_[lengths, 0.0]) < 1e15 and longest < 1e15)
            kind, unit = (np.float32, 2.0**-24) if plain else (np.float64, 2.0**-53)
            # (width + 8) roundings of at most the product of the lengths each, and numbers too small for the precision
            margin = 2 * (width + 8) * unit * lengths * longest + (1e-20 if plain else 0.0)
            items_t = np.ascontiguousarray(vectors.astype(kind).T)
        near_all = np.empty(min(QUESTION_TILE, len(asked)) * min(ITEM_TILE, len(vectors)), kind)
        fine = 2 * (width + 8) * 2.0**-53 * lengths * longest
        found: list[tuple[np.ndarray, np.ndarray]] = []
        gathered = 0

        def scored():
            question, item = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            scores = np.empty(len(item))
            slab = max(1, 2_000_000 // width)
            for start in range(0, len(item), slab):
                part = slice(start, start + slab)
                scores[part] = (vectors[item[part]] * asked[question[part]]).sum(axis=1)
            good = scores >= floor[question]
            return question[good], usable[rows[item[good]]], scores[good]

        for start in range(0, len(asked), QUESTION_TILE):
            group = asked[start : start + QUESTION_TILE].astype(kind)
            low, slack = floor[start : start + QUESTION_TILE], margin[start : start + QUESTION_TILE]
            low = np.where(np.isfinite(slack), low, -np.inf) - np.where(np.isfinite(slack), slack, 0.0)
            for at in range(0, len(vectors), ITEM_TILE):
                tile = items_t[:, at : at + ITEM_TILE]
                near = near_all[: len(group) * tile.shape[1]].reshape(len(group), tile.shape[1])
                with np.errstate(over="ignore", invalid="ignore"):
                    np.matmul(group, tile, out=near)
                if not plain:
                    near[np.isnan(near)] = -np.inf  # no score, which the row-by-row product finds again
                top = near.max(axis=1)
                hit = np.flatnonzero(top >= low)
                if not len(hit):
                    continue
                some, bound = near[hit], low[hit]
                new = np.flatnonzero(bound == -np.inf)
                if len(new) and tile.shape[1] > k:
                    kth = np.partition(some[new], tile.shape[1] - k, axis=1)[:, tile.shape[1] - k].astype(np.float64)
                    wide = slack[hit[new]]
                    bound[new] = np.where(np.isfinite(wide), kth - 2 * wide, -np.inf)
                    low[hit[new]] = bound[new]
                # rounded down, so that comparing in single precision loses none
                reach = some >= np.nextafter(bound.astype(kind), kind(-np.inf))[:, None]
                if plain and tile.shape[1] > k and np.count_nonzero(reach) > len(hit) * (k + tile.shape[1] // 16):
                    # vectors too much alike for single precision: once more in double
                    near64, slack64 = asked[start + hit] @ vectors[at : at + ITEM_TILE].T, fine[start + hit]
                    kth = np.partition(near64, tile.shape[1] - k, axis=1)[:, tile.shape[1] - k]
                    reach &= near64 >= (np.maximum(floor[start + hit], kth) - 2 * slack64)[:, None]
                question, item = np.divmod(np.flatnonzero(reach), tile.shape[1])
                found.append((hit[question] + start, item + at))
                gathered += len(item)
                if gathered >= MAX_CANDIDATES:
                    yield scored()
                    found, gathered = [], 0
        if found:
            yield scored()

    return best


def top_k_chunks(
    questions: DataFrame,
    index: DataFrame,
    top_k: int = TOP_K,
    key: str = "qid",
    attach: Sequence[str] = (),
    max_broadcast: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """Exact top-k chunks by dot product for every question, ranked from 1.

    Both sides hold vectors of one length in ``embedding``. Ties go by document and chunk. A NULL
    vector, or one that holds NULL or NaN, has no score: it is no hit and, as a question, has none.
    *attach* names further index columns to give the hits, such as ``text``.
    """
    _check_top_k(top_k)
    return blocked_top_k(
        questions.select(key, "embedding"),
        index,
        top_k,
        dot_scorer,
        key,
        ties=("doc_name", "chunk_id"),
        values="embedding",
        attach=attach,
        max_broadcast=max_broadcast,
    )


def with_columns_of(
    hits: DataFrame, index: DataFrame, attach: Sequence[str], named: Sequence[str] = ("doc_name", "chunk_id")
) -> DataFrame:
    """The hits with further columns of their index rows, as *attach* of `top_k_chunks` gives them.

    For hits that are filtered or ranked anew first, so that texts need not pass through that. Counts the hits when called.
    *named* are the columns that tell an index row.
    """
    return with_attached(hits, index, named, attach, hits.count() <= MAX_HELD_HITS)


def hit_rows(hits: DataFrame, max_chars: int = PREVIEW_CHARS, key: str = "qid") -> DataFrame:
    """Hits as shown: score to 6 places and a one-line preview of ``text``."""
    return hits.select(
        key,
        "rank",
        "doc_name",
        "chunk_id",
        F.round("score", 6).alias("score"),
        preview("text", max_chars).alias("text"),
    )


def confidence_of(top_score: Column) -> Column:
    return (
        F.when(top_score >= HIGH_SCORE, "high")
        .when(top_score >= MEDIUM_SCORE, "medium")
        .otherwise("low")
    )


def confidence(questions: DataFrame, hits: DataFrame, key: str = "qid") -> DataFrame:
    """Confidence per question from its best unrounded score; no hits is low."""
    best = hits.groupBy(key).agg(F.max("score").alias("top_score"))
    return questions.select(key).join(best, key, "left").select(
        key, confidence_of(F.col("top_score")).alias("confidence")
    )
