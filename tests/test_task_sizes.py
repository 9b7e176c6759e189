"""Tasks that sort or group hold a bounded number of rows, however large the table is."""

import pyarrow as pa
import pytest

from rankwell import runtime
from rankwell.functions import splitting
from rankwell.operators import evaluation as V, matching as M


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def fifty_rows(monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_PER_TASK", 50)


def test_degree_match_counts_degrees_times_requirements(spark, fifty_rows):
    degrees = spark.range(1000).selectExpr(
        "'r' AS role", "id % 100 AS candidate_id", "id AS pos", "if(id % 200 < 100, 'Zoo', 'Executive MBA') AS degree", "concat('school ', id) AS institution")
    reqs = spark.createDataFrame([("r", 1, "MBA"), ("r", 2, "Poetry")], "role string, req_id int, req_name string")
    found = M.degree_match(degrees, reqs)
    assert ", 40), REPARTITION_BY_NUM" in plan(found)
    rows = {(r.candidate_id, r.req_id): (r.matched, r.degree, r.institution) for r in found.collect()}
    assert len(rows) == 200
    assert rows[7, 1] == (True, "Executive MBA", "school 107") and rows[7, 2] == (False, None, None)
    assert M.degree_match(degrees.limit(0), reqs).count() == 0


def test_judge_total_counts_its_rows(spark, fifty_rows):
    judge = spark.range(1000).selectExpr("'r' AS role", "id % 50 AS candidate_id", "CAST(id % 4 AS INT) AS req_id", "0.5D AS sub_score")
    weights = spark.createDataFrame([("r", 0, 10.0), ("r", 2, 30.0)], "role string, req_id int, weight_pct double")
    explicit = spark.createDataFrame([("r", 4, 0, 20.0), ("r", 999, 0, 1.0)], "role string, candidate_id long, req_id int, sub_score_sum double")
    totals = V.judge_total(judge, weights, explicit)
    assert plan(totals).count(", 20), REPARTITION_BY_NUM") == 2
    rows = {r.candidate_id: r.judge_total for r in totals.collect()}
    assert rows[0] == 20.0 and rows[4] == 10 * 20.0 / 10 + 15.0 and 1 not in rows and 999 not in rows


def test_a_batch_of_texts_is_split_a_few_at_a_time():
    texts = pa.array(["a" * 30, None, "", "b" * 90, "c"] * 20)
    parts = list(splitting.slices(texts, 100))
    assert pa.concat_arrays(parts).equals(texts)
    assert max(len("".join(t or "" for t in p.to_pylist())) for p in parts) <= 190
    assert [len(p) for p in splitting.slices(texts.slice(0, 0), 100)] == [0]
