"""Chunking, vector retrieval and lexical retrieval over `documents`, `embeddings`, `benchmark`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrain.catalog.views import (
    SQL_STRIP_CHARS,
    chunk_texts,
    corpus,
    sql_tokens,
    table,
    vector_chunks,
    vector_index,
    vector_questions,
    with_views,
)
from citegrain.functions import text as tx
from citegrain.operators import chunks, embedding_store, lexical, vectors
from citegrain.plans.workdir import shared_dir, written


def line_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.paragraph_chunks(corpus(s, d), "\n")


def without_self(hits: DataFrame, top_k: int) -> DataFrame:
    """Leave-one-out: a question's own vector is no hit. *hits* hold one more rank than *top_k*."""
    order = Window.partitionBy("qid").orderBy("rank")
    return (
        hits.filter(F.col("chunk_id") != F.col("qid"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
    )


def shortened(df: DataFrame, dimensions: int = 32) -> DataFrame:
    """The same rows under a smaller embedding: the leading dimensions, scaled to unit length."""
    return df.withColumn("embedding", vectors.normalized(F.slice("embedding", 1, dimensions)))


def vector_hits(s: SparkSession, d: str, top_k: int = 3, short: bool = False, attach=("text",), chars: int | None = None) -> DataFrame:
    questions, index = vector_questions(s, d), vector_chunks(s, d)
    if short:
        questions, index = shortened(questions), shortened(index)
    hits = written(without_self(vectors.top_k_chunks(questions, index, top_k + 1), top_k))
    return with_texts(s, d, hits, attach, chars) if attach else hits


def with_texts(s: SparkSession, d: str, hits: DataFrame, attach=("text",), chars: int | None = None) -> DataFrame:
    """Written hits with the texts of their chunks, joined last: windows and copies of hits go without.

    With *chars* only that many first characters of a text are shuffled. The smallest of several texts begins with the
    smallest beginning, so these are the first characters of the same text.
    """
    texts, named = chunk_texts(s, d)
    if chars is not None:
        texts = texts.withColumn("text", F.substring("text", 1, chars))
    return vectors.with_columns_of(hits, texts, attach, named)


def _bare_hits(s: SparkSession, d: str, top_k: int, short: bool = False, **how: int) -> DataFrame:
    asked = table(s, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    index = vector_index(s, d)
    if short:
        asked, index = shortened(asked), shortened(index)
    return without_self(vectors.top_k_chunks(asked, index, top_k + 1, **how), top_k)


def _scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def _even_direction(s: SparkSession, d: str) -> DataFrame:
    hits = vectors.search(vector_index(s, d), [1.0] * 64, 10)
    return _scored(hits)


def _unit(s: SparkSession, d: str) -> DataFrame:
    scaled = table(s, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x * 3).alias("embedding")
    )
    return scaled.select(
        "vec_id",
        F.round(F.get(vectors.normalized(F.col("embedding")), F.lit(0)), 5).alias("first"),
        F.round(
            vectors.dot(vectors.normalized(F.col("embedding")), vectors.normalized(F.col("embedding"))), 6
        ).alias("norm"),
    )


def _hashed(s: SparkSession, d: str) -> DataFrame:
    """Per chunk of the whole corpus: filled buckets, and the weight and place of the fullest."""
    embedded = vectors.hashed_embedding(line_chunks(s, d))
    return embedded.select(
        "doc_name",
        "chunk_id",
        F.size(F.filter("embedding", lambda x: x > 0)).alias("filled"),
        F.round(F.array_max("embedding").cast("double"), 5).alias("top_weight"),
        F.array_position("embedding", F.array_max("embedding")).cast("int").alias("top_bucket"),
    )


def _benchmark_questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _hashed_search(s: SparkSession, d: str) -> DataFrame:
    """Text to hits: every benchmark text against every chunk, both hashed."""
    asked = vectors.hashed_embedding(
        vectors.checked_questions(_benchmark_questions(s, d), 3), text="query"
    )
    index = vectors.hashed_embedding(line_chunks(s, d))
    hits = vectors.top_k_chunks(asked, index, 3, attach=["text"])
    return vectors.hit_rows(hits)


def _token_rows(s: SparkSession, d: str) -> DataFrame:
    bag = tx.tokens("text")
    return corpus(s, d).select(
        "doc_name",
        F.size(bag).alias("n_tokens"),
        F.size(F.array_distinct(bag)).alias("n_distinct"),
        F.md5(F.array_join(bag, " ")).alias("tokens_md5"),
    )


#: The letters that the stand-in model counts.
LETTERS = "aeinorst"


def letter_model():
    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=float)

    return predict


def _stored_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents from a store that knew the English ones before."""
    docs, store = table(s, d, "documents").select("doc_id", "lang", "text"), shared_dir(s)
    embedding_store.update(docs.filter("lang = 'en'"), store, "letters", letter_model)
    embedding_store.update(docs, store, "letters", letter_model)
    rows = embedding_store.with_embeddings(docs, store, "letters")
    return rows.select("doc_id", *[F.round(F.get("embedding", F.lit(i)), 9).alias(f"v{i}") for i in range(len(LETTERS))])


QUERIES = {
    "b1_paragraph_chunks": line_chunks,
    "b2_corpus_counts": lambda s, d: chunks.corpus_counts(line_chunks(s, d)),
    "b3_previews": lambda s, d: corpus(s, d).select(
        "doc_name", tx.preview("text").alias("preview"), tx.preview("text", 200).alias("preview_200")
    ),
    "b4_hard_previews": lambda s, d: corpus(s, d).select(
        "doc_name", *[tx.hard_preview("text", n).alias(f"head_{n}") for n in (80, 180, 200, 220)]
    ),
    "b5_labels_and_blocks": lambda s, d: line_chunks(s, d).select(
        tx.chunk_label("doc_name", "chunk_id").alias("label"),
        tx.context_block(tx.chunk_label("doc_name", "chunk_id"), "text").alias("block"),
    ),
    "b6_tokens": _token_rows,
    "c1_hashed_embedding": _hashed,
    "c1_hashed_text_search": _hashed_search,
    "c2_unit_vectors": _unit,
    "c3_c4_search_one_vector": _even_direction,
    "c5_top_k_chunks": lambda s, d: _scored(_bare_hits(s, d, 3)),
    "c5_top_k_chunks_short_vectors": lambda s, d: _scored(_bare_hits(s, d, 5, short=True)),
    "c5_top_k_in_blocks": lambda s, d: _scored(_bare_hits(s, d, 3, max_broadcast=100)),
    "c6_hit_rows": lambda s, d: vectors.hit_rows(vector_hits(s, d, chars=vectors.PREVIEW_CHARS + 1)),
    "c7_confidence": lambda s, d: vectors.confidence(
        table(s, d, "embeddings").select(F.col("vec_id").alias("qid")), _bare_hits(s, d, 3)
    ),
    "c8_checked_questions": lambda s, d: vectors.checked_questions(
        table(s, d, "conversations").select("conv_id", "turn", tx.strip("text").alias("query")), 20
    ),
    "b1_sliding_chunks": lambda s, d: chunks.sliding_chunks(corpus(s, d), 300, 75).withColumn("text", F.md5("text")),
    "c1_embedding_store": _stored_vectors,
    "d1_d2_d3_search_documents": lambda s, d: lexical.search_documents(
        _benchmark_questions(s, d), corpus(s, d)
    ),
    "d2_search_documents_top_7": lambda s, d: lexical.search_documents(
        _benchmark_questions(s, d), corpus(s, d), 7
    ).drop("snippet"),
}

_TRIM = "trim({0}, " + SQL_STRIP_CHARS + ")"

SQL_LINE_CHUNKS = f"""
    SELECT doc_name, CAST(pos - 1 AS INT) AS chunk_id, parts[pos] AS text
    FROM (SELECT doc_name, parts, unnest(range(1, len(parts) + 1)) AS pos
          FROM (SELECT doc_name, list_filter(list_transform(string_split(text, chr(10)),
                  lambda p: {_TRIM.format('p')}), lambda p: p <> '') AS parts FROM corpus))"""


def sql_preview(text: str, n: int) -> str:
    flat = f"replace({text}, chr(10), ' ')"
    return (
        f"CASE WHEN length({flat}) > {n} THEN rtrim(substr({flat}, 1, {n}), {SQL_STRIP_CHARS}) || '...' "
        f"ELSE {flat} END"
    )


SQL_SHORT = """list_transform(embedding[1:32], lambda x:
    x / sqrt(list_sum(list_transform(embedding[1:32], lambda y: y * y))))"""


def sql_vector_hits(top_k: int, short: bool = False, source: str = "vector_chunks") -> str:
    """Leave-one-out hits of every vector from all scores of the view *source*."""
    vector = SQL_SHORT if short else "embedding"
    asked = f"(SELECT vec_id AS chunk_id, {vector} AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings))"
    return f"""
        SELECT qid, rank, doc_name, chunk_id, score, text
        FROM (SELECT q.chunk_id AS qid, c.doc_name, c.chunk_id, c.text,
                list_dot_product(q.v, c.v) AS score,
                CAST(row_number() OVER (PARTITION BY q.chunk_id
                  ORDER BY list_dot_product(q.v, c.v) DESC, c.doc_name, c.chunk_id) AS INT) AS rank
              FROM {asked} q
              JOIN (SELECT doc_name, chunk_id, text, {vector} AS v FROM {source}) c
                ON q.chunk_id <> c.chunk_id)
        WHERE rank <= {top_k}"""


SQL_LEXICAL_SCORES = f"""
    SELECT q.qid, d.doc_name, d.text, CAST(coalesce(p.points, 0) AS BIGINT) AS score
    FROM asked q CROSS JOIN corpus d
    LEFT JOIN (SELECT qid, doc_name, sum(n) AS points
               FROM (SELECT qid, t, count(*) AS n
                     FROM (SELECT qid, unnest({sql_tokens('query')}) AS t FROM asked) GROUP BY qid, t)
               JOIN (SELECT DISTINCT doc_name, t
                     FROM (SELECT doc_name, unnest({sql_tokens('text')}) AS t FROM corpus)) USING (t)
               GROUP BY qid, doc_name) p
      ON p.qid = q.qid AND p.doc_name = d.doc_name"""


def sql_lexical_hits(top_k: int) -> str:
    return f"""
        SELECT qid, rank, doc_name, score, replace(substr({_TRIM.format('text')}, 1, 180), chr(10), ' ') AS snippet
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_name) AS INT) AS rank
              FROM ({SQL_LEXICAL_SCORES}))
        WHERE rank <= {top_k}"""


_ASKED = "SELECT item_id AS qid, text AS query FROM benchmark"


def _murmur(token: str) -> str:
    """Murmur3 of an ASCII token in plain arithmetic, the documented hash of the bucket transform.

    Whole numbers of 128 bits leave room for the 64-bit products; every step is cut to 32 bits.
    """

    def big(n: int) -> str:
        return f"CAST({n} AS HUGEINT)"

    word = big(2**32 - 1)

    def rotate(x: str, n: int) -> str:
        return f"(((({x}) * {big(2**n)}) | (({x}) // {big(2 ** (32 - n))})) & {word})"

    def mixed(k: str) -> str:
        a = f"((({k}) * {big(3432918353)}) & {word})"
        return f"(({rotate(a, 15)} * {big(461845907)}) & {word})"

    def byte(at: str, weight: int) -> str:
        return f"CAST(ascii(substr({token}, CAST({at} AS BIGINT), 1)) AS HUGEINT) * {big(weight)}"

    block = " + ".join(byte(f"b * 4 + {i + 1}", 256**i) for i in range(4))
    blocks = f"list_transform(range(length({token}) // 4), lambda b: {mixed(block)})"
    step = f"(({rotate('xor(h, k)', 13)} * {big(5)} + {big(3864292196)}) & {word})"
    body = f"list_reduce(list_prepend({big(42)}, {blocks}), lambda h, k: {step})"
    left = f"(length({token}) % 4)"
    at = f"(length({token}) - {left})"
    tail = " + ".join(
        f"CASE WHEN {left} > {i} THEN {byte(f'{at} + {i + 1}', 256**i)} ELSE {big(0)} END"
        for i in range(3)
    )
    return (
        f"{body} AS h0, CASE WHEN {left} > 0 THEN {mixed(tail)} ELSE {big(0)} END AS k0, "
        f"CAST(length({token}) AS HUGEINT) AS n0"
    )


def _sql_buckets(source: str, text: str, keys: str) -> str:
    """Rows (keys, bucket, n): the token counts per hash bucket of each text."""
    word = "CAST(4294967295 AS HUGEINT)"

    def down(x: str, n: int) -> str:
        return f"xor({x}, {x} // CAST({2**n} AS HUGEINT))"

    return f"""
        SELECT {keys}, CAST(h % 256 AS INT) AS bucket, count(*) AS n
        FROM (SELECT {keys}, {down('x3', 16)} AS h
          FROM (SELECT {keys}, ({down('x2', 13)} * CAST(3266489909 AS HUGEINT)) & {word} AS x3
            FROM (SELECT {keys}, ({down('x1', 16)} * CAST(2246822507 AS HUGEINT)) & {word} AS x2
              FROM (SELECT {keys}, xor(xor(h0, k0), n0) AS x1
                FROM (SELECT {keys}, {_murmur('t')}
                  FROM (SELECT {keys}, unnest({sql_tokens(text)}) AS t FROM {source}))))))
        GROUP BY {keys}, bucket"""


_SQL_HASHED = """
    SELECT c.doc_name, c.chunk_id, CAST(count(b.bucket) AS INT) AS filled,
      round(CAST(coalesce(max(CAST(b.n / sqrt(s.squares) AS FLOAT)), 0) AS DOUBLE), 5) AS top_weight,
      CAST(coalesce(min(b.bucket + 1) FILTER (b.n = s.most), 1) AS INT) AS top_bucket
    FROM line_chunks c
    LEFT JOIN buckets b USING (doc_name, chunk_id)
    LEFT JOIN (SELECT doc_name, chunk_id, sum(n * n) AS squares, max(n) AS most
               FROM buckets GROUP BY ALL) s USING (doc_name, chunk_id)
    GROUP BY c.doc_name, c.chunk_id"""

_SQL_HASHED_SEARCH = f"""
    SELECT qid, rank, doc_name, chunk_id, round(score, 6) AS score, {sql_preview('text', 220)} AS text
    FROM (SELECT q.qid, c.doc_name, c.chunk_id, c.text, coalesce(p.score, 0) AS score,
            CAST(row_number() OVER (PARTITION BY q.qid
              ORDER BY round(coalesce(p.score, 0), 9) DESC, c.doc_name, c.chunk_id) AS INT) AS rank
          FROM asked q CROSS JOIN line_chunks c
          LEFT JOIN (SELECT a.qid, b.doc_name, b.chunk_id,
                       sum(CAST(a.w AS DOUBLE) * CAST(b.w AS DOUBLE)) AS score
                     FROM (SELECT qid, bucket, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY qid)) AS FLOAT) AS w FROM asked_buckets) a
                     JOIN (SELECT doc_name, chunk_id, bucket, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_name, chunk_id)) AS FLOAT) AS w FROM buckets) b
                       USING (bucket)
                     GROUP BY ALL) p
            ON p.qid = q.qid AND p.doc_name = c.doc_name AND p.chunk_id = c.chunk_id)
    WHERE rank <= 3"""

SQL = {
    "b1_paragraph_chunks": with_views(SQL_LINE_CHUNKS, "corpus"),
    "b2_corpus_counts": with_views(
        "SELECT count(*) AS chunk_count, count(DISTINCT doc_name) AS doc_count FROM line_chunks",
        "corpus",
        line_chunks=SQL_LINE_CHUNKS,
    ),
    "b3_previews": with_views(
        f"SELECT doc_name, {sql_preview('text', 220)} AS preview, {sql_preview('text', 200)} AS preview_200 FROM corpus",
        "corpus",
    ),
    "b4_hard_previews": with_views(
        "SELECT doc_name, "
        + ", ".join(f"substr(replace(text, chr(10), ' '), 1, {n}) AS head_{n}" for n in (80, 180, 200, 220))
        + " FROM corpus",
        "corpus",
    ),
    "b5_labels_and_blocks": with_views(
        """SELECT doc_name || '#chunk' || chunk_id AS label,
             '[' || doc_name || '#chunk' || chunk_id || '] ' || text AS block FROM line_chunks""",
        "corpus",
        line_chunks=SQL_LINE_CHUNKS,
    ),
    "b6_tokens": with_views(
        f"""SELECT doc_name, CAST(len(bag) AS INT) AS n_tokens, CAST(len(list_distinct(bag)) AS INT) AS n_distinct,
              md5(array_to_string(bag, ' ')) AS tokens_md5
            FROM (SELECT doc_name, {sql_tokens('text')} AS bag FROM corpus)""",
        "corpus",
    ),
    "c1_hashed_embedding": with_views(
        _SQL_HASHED,
        "corpus",
        line_chunks=SQL_LINE_CHUNKS,
        buckets=_sql_buckets("line_chunks", "text", "doc_name, chunk_id"),
    ),
    "c1_hashed_text_search": with_views(
        _SQL_HASHED_SEARCH,
        "corpus",
        line_chunks=SQL_LINE_CHUNKS,
        buckets=_sql_buckets("line_chunks", "text", "doc_name, chunk_id"),
        asked=_ASKED + " WHERE length(text) >= 1",
        asked_buckets=_sql_buckets("asked", "query", "qid"),
    ),
    "c2_unit_vectors": """
        SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first, 1.0::DOUBLE AS norm
        FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS v FROM embeddings)""",
    "c3_c4_search_one_vector": with_views(
        """SELECT doc_name, chunk_id, round(list_sum(embedding) / 8, 6) AS score FROM vector_index
           ORDER BY list_sum(embedding) DESC, doc_name, chunk_id LIMIT 10""",
        "vector_index",
    ),
    "c5_top_k_chunks": with_views(
        "SELECT qid, rank, doc_name, chunk_id, round(score, 6) AS score FROM hits",
        "vector_index",
        hits=sql_vector_hits(3, source="vector_index"),
    ),
    "c5_top_k_in_blocks": with_views(
        "SELECT qid, rank, doc_name, chunk_id, round(score, 6) AS score FROM hits",
        "vector_index",
        hits=sql_vector_hits(3, source="vector_index"),
    ),
    "c5_top_k_chunks_short_vectors": with_views(
        "SELECT qid, rank, doc_name, chunk_id, round(score, 6) AS score FROM hits",
        "vector_index",
        hits=sql_vector_hits(5, short=True, source="vector_index"),
    ),
    "c6_hit_rows": with_views(
        f"SELECT qid, rank, doc_name, chunk_id, round(score, 6) AS score, {sql_preview('text', 220)} AS text FROM hits",
        "vector_chunks",
        hits=sql_vector_hits(3),
    ),
    "c7_confidence": with_views(
        """SELECT qid, CASE WHEN max(score) >= 0.75 THEN 'high' WHEN max(score) >= 0.55 THEN 'medium'
             ELSE 'low' END AS confidence FROM hits GROUP BY qid""",
        "vector_index",
        hits=sql_vector_hits(3, source="vector_index"),
    ),
    "c8_checked_questions": f"""
        SELECT conv_id, turn, query FROM (SELECT conv_id, turn, {_TRIM.format('text')} AS query FROM conversations)
        WHERE length(query) >= 1""",
    "b1_sliding_chunks": with_views(
        """SELECT doc_name, CAST(i AS INT) AS chunk_id, CAST(i * 225 AS BIGINT) AS chunk_start,
             CAST(least(i * 225 + 300, n) AS BIGINT) AS chunk_end, md5(substr(text, i * 225 + 1, 300)) AS text
           FROM (SELECT doc_name, text, length(text) AS n,
                   unnest(range(0, 1 + CAST(greatest(ceil((length(text) - 300) / 225), 0) AS BIGINT))) AS i
                 FROM corpus WHERE length(text) > 0)""",
        "corpus",
    ),
    "c1_embedding_store": "SELECT doc_id, "
    + ", ".join(f"round(CASE WHEN size = 0 THEN 0 ELSE c[{i + 1}] / size END, 9) AS v{i}" for i in range(len(LETTERS)))
    + " FROM (SELECT doc_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS size FROM (SELECT doc_id, ["
    + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in LETTERS)
    + "] AS c FROM documents))",
    "d1_d2_d3_search_documents": with_views(sql_lexical_hits(2), "corpus", asked=_ASKED),
    "d2_search_documents_top_7": with_views(
        f"SELECT qid, rank, doc_name, score FROM ({sql_lexical_hits(7)})", "corpus", asked=_ASKED
    ),
}
