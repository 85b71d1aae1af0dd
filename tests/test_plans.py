"""What the physical plans must and must not hold."""

import pytest

from citegrain.catalog import registry
from citegrain.catalog.views import request_log, vector_chunks, vector_index, vector_questions
from citegrain.operators import logs, vectors

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", registry.queries())
def test_no_cross_join(spark, name):
    if name.startswith(("k", "a5")):
        pytest.skip("runs as a stream")
    plan = plan_of(registry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned(spark):
    plan = plan_of(logs.requests_by(request_log(spark, SF_DIR), "provider"))
    assert "ReadSchema: struct<user_id:bigint>" in plan


def test_filters_are_pushed(spark):
    plan = plan_of(logs.error_samples(request_log(spark, SF_DIR)))
    assert "TakeOrderedAndProject" in plan
    plan = plan_of(request_log(spark, SF_DIR).filter("event_id > 5").select("event_id"))
    assert "GreaterThan(event_id,5)" in plan


def test_top_k_reads_the_index_in_place(spark):
    questions = vector_questions(spark, SF_DIR)
    plan = plan_of(vectors.top_k_chunks(questions, vector_index(spark, SF_DIR), 3))
    # one shuffle, of the kept rows; each task first keeps k rows per question
    assert plan.count("Exchange hashpartitioning") == 1
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan


def test_percentiles_read_the_log_once(spark):
    for by in ([], ["endpoint"]):
        df = logs.slo_check(request_log(spark, SF_DIR), by)
        df.collect()
        final = plan_of(df).split("== Initial Plan ==")[0]
        assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("n_vectors, unions", [(3, 0), (6, 1)])
def test_texts_are_joined_again_only_for_vectors_beyond_the_documents(spark, tmp_path, n_vectors, unions):
    docs = [(i, f"text {i}", "en", "s") for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [float(i), 1.0], 0) for i in range(n_vectors)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    chunks = vector_chunks(spark, str(tmp_path))
    assert plan_of(chunks).split("== Initial Plan ==")[-1].count("Union") == unions
    assert sorted(r["chunk_id"] for r in chunks.collect()) == list(range(max(4, n_vectors)))


@pytest.mark.parametrize("name", ["g1_run_aggregate", "g2_last_per_id", "g3_g4_paired_deltas", "g5_change_counts", "g6_retrieval_metrics"])
def test_runs_are_compared_from_written_rows(spark, name):
    """Sorting, sampling and joining both runs must not search, answer or score again."""
    plan = plan_of(registry.queries()[name](spark, SF_DIR))
    assert "documents.parquet" not in plan and "events.parquet" not in plan and "MapInArrow" not in plan
