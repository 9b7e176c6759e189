"""What the plans must and must not contain."""

import os

import pytest
from pyspark.sql import functions as F

from rankwell.operators import ranking as K, retrieval as R
from rankwell.plans import QUERIES
from rankwell.runtime import small_side

SF = "/root/testdata/sf0.001"
WITH_PYTHON = {"chunk_recursive", "cosine_baseline_rank", "rank_correlation", "study_stability", "baseline_stability", "baseline_alignment"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_stray_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert name in WITH_PYTHON or "ArrowEvalPython" not in text


def test_top_k_is_trimmed_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("role"), F.col("id").alias("candidate_id"), F.rand(1).alias("total"))
    text = plan(K.rank_candidates(df, top_k=5))
    assert text.count("WindowGroupLimit") == 2


def test_queries_are_broadcast_and_chunks_stay_put(spark):
    chunks = spark.range(50).selectExpr("if(id > 9, 'r', 's') AS role", "id AS candidate_id", "id AS chunk_id", "array(1f, 2f) AS embedding")
    queries = spark.createDataFrame([("r", 1, 0, [1.0, 0.0])], "role string, req_id int, sq_pos int, query array<float>")
    text = plan(R.cosine_scores(chunks, queries))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_a_large_side_gets_no_hint(spark):
    from pyspark.sql import DataFrame

    def hinted(df: DataFrame) -> bool:
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    df = spark.range(1000).select("id")
    assert hinted(small_side(df)) and not hinted(small_side(df, max_rows=999)) and not hinted(small_side(df, max_bytes=100))
