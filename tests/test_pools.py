"""A role's pool holds all of its candidates, with or without totals."""

from rankwell.operators import ranking as K


def test_a_role_without_totals_is_compared_too(spark):
    totals = [("a", 1, None), ("a", 2, None), ("b", 1, None), ("b", 2, 4.0), ("b", 3, 1.0)]
    ranked = K.rank_candidates(spark.createDataFrame(totals, "role string, candidate_id int, total double"))
    rows = {(r.role, r.candidate_id): (r["rank"], r.pool_max, r.pool_mean, r.pool_min, r.pool_size, r.pool_median) for r in K.pool_comparison(ranked).collect()}
    assert rows == {
        ("a", 1): (1, None, None, None, 2, None), ("a", 2): (2, None, None, None, 2, None),
        ("b", 2): (1, 4.0, 2.5, 1.0, 3, 2.5), ("b", 3): (2, 4.0, 2.5, 1.0, 3, 2.5), ("b", 1): (3, 4.0, 2.5, 1.0, 3, 2.5),
    }
