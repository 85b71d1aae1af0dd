import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.catalog import retrieval_queries, views
from citegrain.operators import answers, embedding_store, lexical, vectors
from citegrain.operators.chunks import paragraph_chunks
from citegrain.plans import block_topk, postings

GRID = {"max_broadcast": 7}


@pytest.fixture(scope="module")
def spaces(spark):
    """Questions and an index a third of which are copies of one vector."""
    rng = np.random.default_rng(1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    index = unit(rng.normal(size=(300, 16))).astype(np.float32).astype(float)
    index[rng.permutation(300)[:100]] = index[0]
    asked = unit(rng.normal(size=(25, 16)))
    asked[3] = index[0]
    names = [(f"d{i % 13:02d}", i) for i in rng.permutation(300).tolist()]
    items = spark.createDataFrame(
        [(n, i, v.tolist(), f"text {n} {i}") for (n, i), v in zip(names, index)],
        "doc_name string, chunk_id long, embedding array<double>, text string",
    ).repartition(6)
    questions = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(asked)], "qid long, embedding array<double>"
    )
    scores = {}
    for q, v in enumerate(asked):
        rows = [(-(w * v).sum(), n, i) for (n, i), w in zip(names, index)]
        scores[q] = [(n, int(i)) for _, n, i in sorted(rows)]
    return questions, items, scores


@pytest.mark.parametrize("how", [{}, GRID], ids=["broadcast", "blocks"])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_top_k_is_the_full_sort(spark, spaces, how, k):
    questions, items, scores = spaces
    hits = vectors.top_k_chunks(questions, items, k, attach=["text"], **how).collect()
    for q, want in scores.items():
        mine = sorted((r for r in hits if r.qid == q), key=lambda r: r["rank"])
        assert [(r.doc_name, r.chunk_id) for r in mine] == want[:k]
        assert [r["rank"] for r in mine] == list(range(1, min(k, 300) + 1))
        assert all(r.text == f"text {r.doc_name} {r.chunk_id}" for r in mine)


def test_blocks_of_questions_are_no_jobs_of_their_own(spark, spaces):
    """One search of the items, however few questions may be broadcast."""
    questions, items, scores = spaces
    spark.sparkContext.setJobGroup("grid", "one search")
    try:
        hits = vectors.top_k_chunks(questions, items, 3, max_broadcast=1).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("grid")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(hits) == 3 * len(scores) and len(jobs) < 15


@pytest.mark.parametrize("spread", [1e-3, 1e-7, 1e-12])
def test_candidates_in_single_precision_lose_no_hit(spark, monkeypatch, spread):
    """Vectors that single precision cannot tell apart, in a grid of many cells, under one repeated and one null key."""
    monkeypatch.setattr(block_topk, "MIN_CELL_SCORES", 500)
    monkeypatch.setattr(block_topk, "FIRST_CHUNK", 8)
    monkeypatch.setattr(vectors, "MAX_CANDIDATES", 50)
    rng = np.random.default_rng(8)
    index = rng.normal(size=(1, 24)) + rng.normal(size=(300, 24)) * spread
    asked = rng.normal(size=(40, 24))
    keys = [None if i % 4 == 0 else 7 if i % 4 == 1 else 100 + i for i in range(40)]
    items = spark.createDataFrame([(f"d{i % 3}", i, v.tolist()) for i, v in enumerate(index)], "doc_name string, chunk_id long, embedding array<double>").repartition(3)
    questions = spark.createDataFrame([(q, v.tolist()) for q, v in zip(keys, asked)], "qid long, embedding array<double>")
    want = {}
    for q, v in zip(keys, asked):
        want.setdefault(q, []).extend((-s, f"d{i % 3}", i) for i, s in enumerate((index * v).sum(axis=1)))
    got = {}
    for r in vectors.top_k_chunks(questions, items, 3, **GRID).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc_name, r.chunk_id))
    assert {q: [x[1:] for x in sorted(rows)] for q, rows in got.items()} == {q: [x[1:] for x in sorted(rows)[:3]] for q, rows in want.items()}


@pytest.mark.parametrize("sizes", [(615_000, 3_000_000), (103_000, 512_000), (10_000_000, 500), (101, 40)])
def test_cells_hold_what_a_task_may_hold(sizes):
    rows, n_items = sizes
    groups, parts = block_topk._grid(rows, rows * 64, n_items, n_items * 64, 4, 48)
    assert rows * 64 <= groups * block_topk.MAX_BROADCAST_VALUES and n_items * 64 <= parts * block_topk.MAX_CELL_VALUES
    # what travels stays within a few times the input
    assert groups * n_items * 64 + parts * rows * 64 <= 12 * (rows + n_items) * 64 or groups * parts <= 60


def test_one_vector(spark, spaces):
    questions, items, scores = spaces
    v = questions.filter("qid = 7").first().embedding
    rows = vectors.search(items, [3 * x for x in v], 4).collect()
    assert [(r.doc_name, r.chunk_id) for r in rows] == scores[7][:4]
    assert vectors.search(items, v, 500).count() == 300
    for bad in (0, -1):
        with pytest.raises(ValueError):
            vectors.search(items, v, bad)
        with pytest.raises(ValueError):
            vectors.top_k_chunks(questions, items, bad)
    with pytest.raises(ValueError):
        vectors.checked_questions(questions, 21)


def test_no_questions(spark, spaces):
    questions, items, _ = spaces
    assert vectors.top_k_chunks(questions.limit(0), items, 3).count() == 0
    assert vectors.top_k_chunks(questions, items.limit(0), 3).count() == 0
    assert vectors.top_k_chunks(questions, items.limit(0), 3, **GRID).count() == 0


def test_normalized_and_confidence(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(vectors.normalized(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    scores = spark.createDataFrame([(0.75,), (0.7499999,), (0.55,), (0.5499,), (None,)], "s double")
    levels = [r[0] for r in scores.select(vectors.confidence_of(F.col("s"))).collect()]
    assert levels == ["high", "medium", "medium", "low", "low"]
    questions = spark.createDataFrame([(1,), (2,)], "qid long")
    hits = spark.createDataFrame([(1, 0.8), (1, 0.2)], "qid long, score double")
    assert sorted(tuple(r) for r in vectors.confidence(questions, hits).collect()) == [(1, "high"), (2, "low")]


def test_hit_rows(spark):
    hits = spark.createDataFrame(
        [(1, 1, "d", 0, 0.123456789, "a\nb" + "x" * 300)], "qid long, rank int, doc_name string, chunk_id int, score double, text string"
    )
    row = vectors.hit_rows(hits, 10).first()
    assert (row.score, row.text) == (0.123457, "a bxxxxxxx...")


def test_model_seam(spark):
    def load():
        def predict(texts):
            return np.array([[len(t), 1.0, 0.0] for t in texts], dtype=np.float32)

        return predict

    docs = spark.createDataFrame([("a.txt", "xxx\n\nyyyy")], "doc_name string, text string")
    rows = vectors.embed(paragraph_chunks(docs), load, batch_size=2).orderBy("chunk_id").collect()
    assert rows[0].embedding == pytest.approx([3 / 10**0.5, 1 / 10**0.5, 0])
    assert rows[1].embedding == pytest.approx([4 / 17**0.5, 1 / 17**0.5, 0])


def test_hashed_search_finds_the_paragraph(spark):
    docs = spark.createDataFrame(
        [("rag.txt", "retrieval comes first\n\ngeneration comes later"), ("api.txt", "routes and servers")],
        "doc_name string, text string",
    )
    asked = spark.createDataFrame([(1, "servers and routes"), (2, "???")], "qid long, query string")
    hits = vectors.top_k_chunks(
        vectors.hashed_embedding(asked, "query"), vectors.hashed_embedding(paragraph_chunks(docs)), 1
    )
    got = {r.qid: (r.doc_name, r.chunk_id, round(r.score, 5)) for r in hits.collect()}
    assert got == {1: ("api.txt", 0, 1.0), 2: ("api.txt", 0, 0.0)}


@pytest.mark.parametrize("how", [{}, GRID], ids=["broadcast", "blocks"])
@pytest.mark.parametrize("k", [0, 2, 5, 90])
def test_token_search_is_the_full_sort(spark, how, k):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)] + ["检索", "文档"]
    weight = np.array([1 / (i + 1) for i in range(32)])
    weight /= weight.sum()
    texts = [" ".join(rng.choice(words, size=rng.integers(0, 12), p=weight)) for _ in range(80)]
    texts[10:36] = [texts[10]] * 26
    asked = [" ".join(rng.choice(words, size=rng.integers(0, 9), p=weight)).upper() for _ in range(30)]
    order = rng.permutation(80).tolist()
    docs = spark.createDataFrame(
        [(f"d{i:02d}", f"\n{texts[i]}") for i in order], "doc_name string, text string"
    ).repartition(5)
    questions = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    hits = lexical.search_documents(questions, docs, k, **how).collect()
    for q, text in enumerate(asked):
        ranked = sorted(
            (-sum(t in set(texts[i].split()) for t in text.lower().split()), f"d{i:02d}", texts[i]) for i in range(80)
        )[: max(1, k)]
        mine = sorted((r for r in hits if r.qid == q), key=lambda r: r["rank"])
        assert [(-r.score, r.doc_name, r.snippet) for r in mine] == [(s, d, t[:180]) for s, d, t in ranked]


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_name string, text string")
    asked = spark.createDataFrame([(1, "x")], "qid long, query string")
    assert lexical.search_documents(asked, docs).count() == 0


@pytest.mark.parametrize("how", [{}, {"max_broadcast": 1}], ids=["broadcast", "blocks"])
def test_vectors_without_a_score_hide_none(spark, how):
    """NULL and NaN vectors are no hits, and NULL tie columns and repeated ids lose and multiply none."""
    nan = float("nan")
    items = spark.createDataFrame(
        [("a", 1, [1.0, 0.0], "t1"), (None, 2, [0.5, 0.5], "t2"), ("c", 3, [nan, 0.0], "t3"), ("d", 4, [0.1, 0.1], "t4"),
         ("e", 5, None, "t5"), ("f", 6, [None, 1.0], "t6"), ("d", 4, [0.1, 0.1], "t0")],
        "doc_name string, chunk_id long, embedding array<double>, text string",
    ).coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0])], "qid long, embedding array<double>")
    got = vectors.top_k_chunks(asked, items, 4, attach=["text"], **how).orderBy("rank").collect()
    assert [(r.qid, r["rank"], r.doc_name, r.chunk_id, r.text) for r in got] == [
        (1, 1, "a", 1, "t1"), (1, 2, None, 2, "t2"), (1, 3, "d", 4, "t0"), (1, 4, "d", 4, "t0")
    ]


def test_long_vectors_keep_their_last_hit(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1, 32)) * 1e6
    index = base + rng.normal(size=(200, 32)) * 1e-6
    scores = (index * base).sum(axis=1)
    items = spark.createDataFrame([("d", i, v.tolist()) for i, v in enumerate(index)], "doc_name string, chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, base[0].tolist())], "qid long, embedding array<double>")
    got = [r.chunk_id for r in vectors.top_k_chunks(asked, items, 5).orderBy("rank").collect()]
    assert got == sorted(range(200), key=lambda i: (-scores[i], i))[:5]


def test_vectors_of_other_lengths_are_refused(spark):
    items = spark.createDataFrame([("a", 1, [1.0, 0.0, 2.0])], "doc_name string, chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    with pytest.raises(Exception, match="vectors of 2 numbers"):
        vectors.top_k_chunks(asked, items, 1).collect()


def test_missing_texts_have_no_tokens(spark):
    docs = spark.createDataFrame([("a", None), ("b", "x y")], "doc_name string, text string")
    asked = spark.createDataFrame([(1, "x"), (2, None)], "qid long, query string")
    got = sorted((r.qid, r["rank"], r.doc_name, r.score, r.snippet) for r in lexical.search_documents(asked, docs).collect())
    assert got == [(1, 1, "b", 1, "x y"), (1, 2, "a", 0, ""), (2, 1, "a", 0, ""), (2, 2, "b", 0, "x y")]


def test_most_documents_are_never_scored(spark):
    """Benchmark questions over real texts: the same hits as scoring all, from under a tenth of the cells."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("doc_name"), "text")
    asked = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    index = lexical.document_index(docs)
    cells, scored = postings.scored_cells(lexical.asked_tokens(asked), index, 2, "qid", "tokens", ("doc_name",))
    assert cells == docs.count() * asked.count() and 0 < scored < 0.1 * cells


@pytest.mark.parametrize("block, chunk", [(4, 8), (256, 8192)])
def test_blocks_of_any_size_give_the_same_hits(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 30)) % 40) for _ in range(90)]
    asked = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 12)) % 50) for _ in range(25)]
    docs = spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(texts)], "doc_name string, text string").repartition(3)
    index = lexical.document_index(docs)
    hits = lexical.search_index(spark.createDataFrame(list(enumerate(asked)), "qid long, query string"), index, 3).collect()
    for q, text in enumerate(asked):
        want = sorted((-sum(t in set(d.split()) for t in text.split()), f"d{i:02d}") for i, d in enumerate(texts))[:3]
        assert [(-r.score, r.doc_name) for r in sorted((r for r in hits if r.qid == q), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("dense", [1, 7, 1024])
def test_long_questions_cost_no_sort_of_their_tokens(spark, monkeypatch, dense):
    """Texts asked as questions: frequent tokens are a matrix product, few cells need the others, hits are those of a full sort."""
    monkeypatch.setattr(postings, "DENSE", dense)
    monkeypatch.setattr(postings, "MAX_POINTS", 50)
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 120)) % 300) for _ in range(300)]
    docs = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)], "doc_name string, text string").repartition(2)
    index = lexical.document_index(docs)
    questions = spark.createDataFrame(list(enumerate(texts[:60])), "qid long, query string")
    hits = lexical.search_index(questions, index, 3).collect()
    sets = [set(t.split()) for t in texts]
    for q, text in enumerate(texts[:60]):
        want = sorted((-sum(t in s for t in text.split()), f"d{i:03d}") for i, s in enumerate(sets))[:3]
        assert [(-r.score, r.doc_name) for r in sorted((r for r in hits if r.qid == q), key=lambda r: r["rank"])] == want


def test_a_store_embeds_only_what_is_new(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def model():
        def predict(texts):
            seen.add(len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return predict

    store = str(tmp_path / "store")
    texts = spark.createDataFrame([(1, "a"), (2, "bbb"), (3, "a"), (4, None), (5, "")], "n long, text string")
    embedding_store.update(texts.filter("n < 3"), store, "m", model)
    embedding_store.update(texts, store, "m", model)
    embedding_store.update(texts, store, "other", model)
    assert seen.value == 2 + 1 + 3
    got = {r.n: r.embedding for r in embedding_store.with_embeddings(texts, store, "m").collect()}
    assert got[4] is None and got[1] == got[3] == pytest.approx([0.5**0.5] * 2) and got[5] == pytest.approx([0.0, 1.0])
    assert embedding_store.stored(spark, store, "none").count() == 0


@pytest.mark.parametrize("n_vectors", [2, 6])
def test_texts_of_hits_are_not_joined_to_labels(spark, tmp_path, n_vectors):
    """Where all chunks are documents their number tells the text, of a repeated one the smallest; else the label does, too."""
    docs = [(0, "b"), (0, "a"), (1, None), (2, "c"), (None, "d")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(i, [float(i + 1), 1.0], i % 2) for i in range(n_vectors)]
    spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits = spark.createDataFrame([(9, 1, "topic0.txt", 0, 0.5), (9, 2, "topic1.txt", 1, 0.25), (8, 1, "topic0.txt", 2, 0.5)], "qid bigint, rank int, doc_name string, chunk_id bigint, score double")
    got = retrieval_queries.with_texts(spark, str(tmp_path), hits)
    assert got.columns == [*hits.columns, "text"]
    assert sorted((r["qid"], r["rank"], r["doc_name"], r["chunk_id"], r["score"], r["text"]) for r in got.collect()) == [
        (8, 1, "topic0.txt", 2, 0.5, "c"), (9, 1, "topic0.txt", 0, 0.5, "a"), (9, 2, "topic1.txt", 1, 0.25, None),
    ]
    assert any("embeddings.parquet" in x for x in got.inputFiles()) == (n_vectors > len(docs))


def test_beginnings_of_texts_give_the_same_records(spark, tmp_path):
    """Records are made of the first characters of texts; of repeated documents the smallest text still counts."""
    long = ["x" * 219 + end for end in ("", "y", "yz", "y\nzz" * 9)] + ["\n é语" * 80, "", None]
    docs = [(i, t) for i, t in enumerate(long)] + [(2, "x" * 219 + "y" + "a" * 50), (3, "x" * 219 + "yb"), (4, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0], 0) for i in range(len(long))], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits = spark.createDataFrame([(i % 3, i, "topic0.txt", i, 0.5) for i in range(len(long))], "qid bigint, rank int, doc_name string, chunk_id bigint, score double")
    asked = spark.createDataFrame([(i, "q") for i in range(3)], "qid bigint, query string")
    whole, heads = (retrieval_queries.with_texts(spark, str(tmp_path), hits, chars=n) for n in (None, answers.SHOWN_CHARS))
    assert max(len(r["text"] or "") for r in heads.collect()) == answers.SHOWN_CHARS < max(len(r["text"] or "") for r in whole.collect())
    of = lambda found: sorted(map(str, answers.answer_records(asked, found).collect()))
    assert of(heads) == of(whole)
    shown = lambda found: sorted(map(str, vectors.hit_rows(found).collect()))
    assert shown(heads) == shown(whole)


@pytest.mark.parametrize("limit", [0, 100])
def test_only_documents_that_word_a_question_are_shuffled(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(views, "MAX_BROADCAST_IDS", limit)
    docs = [(i, f"text {i}", "en", "s") for i in range(9)] + [(1, "again", "fr", "t"), (None, "none", "en", "s")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(i, [1.0], i) for i in (0, 1, 12, None)]
    spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = views.vector_questions(spark, str(tmp_path))
    rows = {(r["qid"], r["expected_keywords"]) for r in got.collect()}
    assert rows == {(0, "text;0"), (1, "text;1"), (1, "again"), (12, "text;1"), (12, "again"), (None, None)}, rows
    assert ("LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()) == (limit > 0)
