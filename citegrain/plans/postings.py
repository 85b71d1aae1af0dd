"""Top-k by overlap over an inverted index, without scoring the documents that cannot enter.

The index is a table with one row for each block of `BLOCK` documents: their payload, the block's
tokens and for each token the places of the documents holding it. Blocks are made where the
documents lie; of each `CHUNK` documents a task meets, those with most tokens come first, so that the k best are
good early. The index is written once and may be kept.

A question's score is one point for each of its tokens, repeats included, that a document holds. A task goes
through its blocks with the broadcast questions:

* The points of the `DENSE` most asked tokens come from one matrix product of questions and a block's documents.
* The other tokens of a question that the block holds at all bound what they can add. Only for documents that may so reach the
  question's k-th score so far is that added, token by token; a question without any such is passed over in this block.

A document without a common token has score 0. It is never scored: a question with fewer than k documents
is filled up from the first 2k - 1 documents by name, of which at most k - 1 can be among its hits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from citegrain.plans.block_topk import MAX_BROADCAST_QUESTIONS, MAX_BROADCAST_VALUES, _measured, _merge_best
from citegrain.plans.workdir import shared_dir, written

BLOCK = 256
CHUNK = 8192
#: Postings expanded at once in a task.
MAX_POINTS = 8_000_000
#: Tokens of the matrix product.
DENSE = 1024


def build_index(documents: DataFrame, tokens: str, payload: Sequence[str]) -> DataFrame:
    """The index of *documents*, written: block, docs (their payload), words, ends, places.

    *tokens* names a column of distinct tokens. ``places[ends[i - 1]:ends[i]]`` are the documents of word i.
    """
    fields = [documents.schema[c] for c in payload]
    doc = T.StructType(fields)
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("docs", T.ArrayType(doc)),
            T.StructField("words", T.ArrayType(T.StringType())),
            T.StructField("ends", T.ArrayType(T.IntegerType())),
            T.StructField("places", T.ArrayType(T.ShortType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def block_row(number: int, part: pa.Table) -> pa.RecordBatch:
        bags = part[tokens].combine_chunks()
        lengths = pc.list_value_length(bags).fill_null(0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(bags.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.repeat(np.arange(part.num_rows), lengths)
        order = np.argsort(codes * BLOCK + place, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
        rows = pa.StructArray.from_arrays(
            [part[c].combine_chunks() for c in payload], fields=[arrow.field("docs").type.value_field.type.field(i) for i in range(len(payload))]
        )
        whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)
        columns = [
            pa.array([number], pa.int64()),
            whole(rows, arrow.field("docs").type),
            whole(coded.dictionary, arrow.field("words").type),
            whole(pa.array(ends, pa.int32()), arrow.field("ends").type),
            whole(pa.array(place[order], pa.int16()), arrow.field("places").type),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def cut() -> Iterator[pa.RecordBatch]:
            nonlocal number
            chunk = pa.Table.from_batches(held)
            size = pc.fill_null(pc.list_value_length(chunk[tokens]), 0)
            chunk = chunk.take(pc.array_sort_indices(size, order="descending"))
            for at in range(0, chunk.num_rows, BLOCK):
                yield block_row(number, chunk.slice(at, BLOCK).combine_chunks())
                number += 1

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, CHUNK - n))
                n, at = n + held[-1].num_rows, at + held[-1].num_rows
                if n == CHUNK:
                    yield from cut()
                    held, n = [], 0
        if held:
            yield from cut()

    return written(documents.select(*payload, tokens).mapInArrow(blocks, schema))


class _Questions:
    """The questions' tokens with their repeats: a matrix of the most asked ones, the others by token."""

    def __init__(self, questions: pa.Table, tokens: str):
        lists = questions[tokens].combine_chunks()
        self.n = len(lists)
        coded = pc.dictionary_encode(lists.flatten())
        self.words = coded.dictionary
        asker = np.repeat(np.arange(self.n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, self.repeats = np.unique(codes * max(self.n, 1) + asker, return_counts=True)
        self.asker = pairs % max(self.n, 1)
        code = pairs // max(self.n, 1)
        self.ends = np.searchsorted(code, np.arange(len(self.words) + 1))
        most = np.argsort(-np.diff(self.ends), kind="stable")[:DENSE]
        self.column = np.full(len(self.words), -1)
        self.column[most] = np.arange(len(most))
        exact = np.float32 if len(coded.indices) < 1 << 24 else np.float64  # whole numbers
        self.weights = np.zeros((self.n, len(most)), exact)
        dense = self.column[code] >= 0
        self.weights[self.asker[dense], self.column[code[dense]]] = self.repeats[dense]


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def _candidates(asked: _Questions, floor: np.ndarray, words: pa.Array, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells (question, place) that may reach *floor*, and their scores, for one block."""
    known = pc.index_in(words, value_set=asked.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    word = np.flatnonzero(known >= 0)
    known = known[word]
    starts = np.concatenate([[0], ends[:-1]])
    column = asked.column[known]
    dense = word[column >= 0]
    held = ends[dense] - starts[dense]
    holds = np.zeros((asked.weights.shape[1], BLOCK), asked.weights.dtype)
    holds[np.repeat(column[column >= 0], held), places[_expanded(starts[dense], held)]] = 1
    scores = asked.weights @ holds
    floor = np.maximum(floor, 1)
    word, known = word[column < 0], known[column < 0]
    sizes = asked.ends[known + 1] - asked.ends[known]
    entry = _expanded(asked.ends[known], sizes)  # one for each other token that a question and the block share
    question, points, word = asked.asker[entry], asked.repeats[entry], np.repeat(word, sizes)
    # the least that the matrix must give, so that the other tokens may do the rest
    least = floor - np.bincount(question, weights=points, minlength=asked.n)
    open_ = np.flatnonzero(scores.max(axis=1, initial=0) >= least)
    at, place = np.nonzero(scores[open_] >= least[open_, None])
    found = scores[open_[at], place].astype(np.float64)
    number = np.full(asked.n, -1)
    number[open_] = np.arange(len(open_))
    kept = number[question] >= 0
    more = _added(number[question[kept]], points[kept], word[kept], len(open_), starts, ends, places)
    return open_[at], place, found + more[at * BLOCK + place]


def _added(row: np.ndarray, points: np.ndarray, word: np.ndarray, n: int, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The points that each of *n* rows has at each place, for entries of a row, its points and a word of the block."""
    held = ends[word] - starts[word]
    upto, at, sums = np.cumsum(held), 0, np.zeros(n * BLOCK)
    while at < len(word):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MAX_POINTS, side="right")))
        size = held[at:stop]
        cell = np.repeat(row[at:stop] * BLOCK, size) + places[_expanded(starts[word[at:stop]], size)]
        sums += np.bincount(cell, weights=np.repeat(points[at:stop], size), minlength=len(sums))
        at = stop
    return sums


def _task_hits(asked_table: pa.Table, batches: Iterator[pa.RecordBatch], k: int, key: str, tokens: str, ties: Sequence[str], counter=None) -> pa.Table | None:
    """The k best documents of each question in a task's blocks: key, block, place, payload, score."""
    asked = _Questions(asked_table, tokens)
    if not asked.n:
        return None
    floor, kept = np.zeros(asked.n), None
    for batch in batches:
        for i in range(batch.num_rows):
            docs, words, ends, places = (batch.column(c)[i].values for c in ("docs", "words", "ends", "places"))
            if words is None or not len(words):
                continue
            question, place, score = _candidates(asked, floor, words, ends.to_numpy().astype(np.int64), places.to_numpy().astype(np.int64))
            if counter is not None:
                counter.append((asked.n * len(docs), len(score)))
            good = score >= np.maximum(floor, 1)[question]
            question, place, score = question[good], place[good], score[good]
            if not len(question):
                continue
            rows = pa.Table.from_batches([pa.RecordBatch.from_struct_array(docs.take(pa.array(place)))])
            rows = rows.append_column("block", pa.array(np.full(len(place), batch.column("block")[i].as_py()))).append_column("place", pa.array(place))
            if kept is not None:
                question, score = np.r_[kept[0], question], np.r_[kept[1], score]
                rows = pa.concat_tables([kept[2], rows])
            kept = _merge_best(question, score, rows, [*ties, "block", "place"], k)
            full = np.bincount(kept[0], minlength=asked.n) >= k
            lowest = np.full(asked.n, np.inf)
            np.minimum.at(lowest, kept[0], kept[1])
            floor = np.where(full, lowest, 0.0)
    if kept is None:
        return None
    question, score, rows = kept
    rows = rows.add_column(0, key, asked_table[key].combine_chunks().take(pa.array(question)))
    return rows.append_column("score", pa.array(score, pa.float64()))


def scored_cells(questions: DataFrame, index: DataFrame, k: int, key: str, tokens: str, ties: Sequence[str]) -> tuple[int, int]:
    """All (question, document) cells of a search, and those that the most asked tokens do not rule out; for questions that fit a broadcast."""
    shared = questions.sparkSession.sparkContext.broadcast(questions.select(key, tokens).toArrow())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: list[tuple[int, int]] = []
        _task_hits(shared.value, batches, k, key, tokens, ties, counter)
        sums = [sum(c[i] for c in counter) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=["cells", "scored"])

    row = index.mapInArrow(count, "cells bigint, scored bigint").agg(F.sum("cells"), F.sum("scored")).first()
    return row[0] or 0, row[1] or 0


def top_overlaps(
    questions: DataFrame, index: DataFrame, k: int, key: str, tokens: str, ties: Sequence[str], max_broadcast: int = MAX_BROADCAST_QUESTIONS
) -> DataFrame:
    """Rows key, rank, payload, score: the k best documents of every question, filled up with score 0 by the ties.

    *questions* have a column of *tokens* with repeats. Up to *max_broadcast* of them (and `MAX_BROADCAST_VALUES`
    tokens) are broadcast at a time, with one pass over the index for each such block.
    """
    spark = questions.sparkSession
    payload = index.schema["docs"].dataType.elementType.names
    asked = written(questions.select(key, tokens))
    rows, held = _measured(asked, tokens)
    n_blocks = max(1, -(-rows // max_broadcast), -(-held // MAX_BROADCAST_VALUES))
    if n_blocks == 1:
        hits = _hits(asked, index, k, key, tokens, ties)
    else:
        n_blocks += n_blocks // 4 + 1  # blocks are hashed, hence not quite equal
        block = F.pmod(F.xxhash64(key), F.lit(n_blocks))
        asked = written(asked.repartition(block).withColumn("question_block", block))
        path = shared_dir(spark)
        for i in range(n_blocks):
            part = asked.filter(F.col("question_block") == i).drop("question_block")
            found = _hits(part, index, k, key, tokens, ties)
            found.write.mode("append").parquet(path)
        hits = spark.read.schema(found.schema).parquet(path)
    hits = written(hits)
    few = asked.select(key).join(hits.groupBy(key).agg(F.count("*").alias("found")), key, "left").filter(F.coalesce("found", F.lit(0)) < k)
    docs = index.select("block", F.posexplode("docs").alias("place", "doc")).select("block", F.col("place").cast("bigint").alias("place"), "doc.*")
    # 0 for every row, but no constant: equal constants would make a cross join, which scans a list instead of a hash table
    same = lambda c: F.pmod(F.xxhash64(c), F.lit(1)).alias("all")
    first = docs.orderBy(*ties, "block", "place").limit(2 * k - 1).select("*", same("block"))
    fill = few.select(key, same(key)).join(F.broadcast(first), "all").drop("all")  # 2k - 1 rows a question
    fill = fill.join(hits.select(key, "block", "place"), [key, "block", "place"], "left_anti").withColumn("score", F.lit(0.0))
    order = Window.partitionBy(key).orderBy(F.desc("score"), *ties, "block", "place")
    both = hits.unionByName(fill.select(*hits.columns)).withColumn("rank", F.row_number().over(order))
    return both.filter(F.col("rank") <= k).select(key, "rank", *ties, "score", *[c for c in payload if c not in ties])


def _hits(questions: DataFrame, index: DataFrame, k: int, key: str, tokens: str, ties: Sequence[str]) -> DataFrame:
    """Hits with a score above 0 of questions that fit a broadcast."""
    doc = index.schema["docs"].dataType.elementType
    more = [T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([questions.schema[key], *doc.fields, *more])
    shared = questions.sparkSession.sparkContext.broadcast(questions.toArrow())
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _task_hits(shared.value, batches, k, key, tokens, ties)
        if found is not None:
            yield from found.select(arrow.names).to_batches()

    order = Window.partitionBy(key).orderBy(F.desc("score"), *ties, "block", "place")
    ranked = index.mapInArrow(scan, schema).withColumn("nth", F.row_number().over(order))
    return ranked.filter(F.col("nth") <= k).drop("nth")
