"""The queries and the pipeline as they are registered."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from citegrain.llm import decontaminate, mixture, queries, toxicity
from tests.compare import difference, duck
from tests.llm.test_near_duplicates import brute

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), duck(SF_DIR), queries.SQL[name]) == ""


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_mix_sources", "op7_url_filter"])
def test_native_queries_run_no_python(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_stages_act_on_what_is_left(spark):
    """Each stage against the operator's own judgement of the stage's input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, SF_DIR).cache()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    clean = toxicity.scored(docs, toxicity.fit(docs, labels)).filter("predicted = 0")
    assert kept.columns == docs.columns and ids(kept) == ids(clean)
    one = stages["simhash"](spark, kept, SF_DIR).cache()
    want = sorted(doc_id for _, doc_id in brute([(r["doc_id"], r["text"]) for r in kept.collect()]))
    assert ids(one) == want
    free = stages["decontamination"](spark, one, SF_DIR).cache()
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert ids(free) == ids(decontaminate.judged(one, benchmark).filter("not contaminated"))
    mixed = stages["mixing"](spark, free, SF_DIR).cache()
    taken = mixture.mix(free).filter("copies > 0").collect()
    assert ids(mixed) == sorted(r["doc_id"] for r in taken for _ in range(r["copies"]))
    sharded = stages["sharding"](spark, mixed, SF_DIR)
    assert ids(sharded) == ids(mixed) and {r["shard"] for r in sharded.collect()} <= set(range(8))
    assert ids(corpus_pipeline.run(spark, SF_DIR)) == ids(sharded)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())
