"""Rules of SQL statements that only large tables or rare numbers reach, on rows made for them."""

import math

import duckdb
import pytest

from rankwell.operators import scoring
from rankwell.plans import ORACLES
from rankwell.plans.catalog import oracle_query
from rankwell.plans.scoring import _share


@pytest.fixture
def con():
    return duckdb.connect()


def test_numbers_of_allocated_ids_are_never_cut(con):
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'src1' AS source FROM range(10050) r(i)")
    con.execute("CREATE TABLE labels AS SELECT i AS doc_id FROM range(10020) r(i)")
    ids = [r[2] for r in con.execute(ORACLES["allocate_ids"]).fetchall()]
    assert len(set(ids)) == len(ids) == 10050 and max(int(i.split("_")[2]) for i in ids) == 10050 and "src1_CAND_0001" in ids


def test_numbers_of_candidates_asked_for_are_never_cut(con):
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 'M' AS c_mktsegment, 'x' AS c_name, 0.0 AS c_acctbal FROM range(12000) r(i)")
    ids = [r[0] for r in con.execute(oracle_query("SELECT candidate_id FROM {customer_totals}")).fetchall()]
    assert len(set(ids)) == len(ids) and {"M_CAND_0007", "M_CAND_11999"} <= set(ids)


def test_a_tiny_negative_number_rounds_to_plain_zero(con):
    con.execute("CREATE TABLE embeddings AS SELECT 1 AS vec_id, [1.0, -1e-9]::FLOAT[] AS embedding, 0 AS label")
    unit = con.execute(ORACLES["l2_normalize"]).fetchall()[0][1]
    assert unit == [1.0, 0.0] and math.copysign(1, unit[1]) == 1


@pytest.mark.parametrize("weight, scores, want", [(10.137, (0.3, 0.6), 4.5617), (14.2145, (0.9,), 12.7931)])
def test_contributions_round_exact_halves_up_on_both_sides(spark, con, weight, scores, want):
    rows = [("r", 1, "q", s) for s in scores]
    keys = "role string, candidate_id int, req_id string"
    out = scoring.req_scores(
        spark.createDataFrame(rows, keys + ", sub_score double"),
        spark.createDataFrame([("r", "q", weight)], "role string, req_id string, weight_pct double"),
    ).first()
    total = " + ".join(f"CAST({s} AS DOUBLE)" for s in scores)
    assert out.contribution == con.execute(f"SELECT {_share(f'CAST({weight} AS DOUBLE)', total, str(len(scores)))}").fetchone()[0] == want
