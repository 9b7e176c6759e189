import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankwell.operators import ranking as K, stability as S


def test_row_numbers_on_a_hot_group(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("role"),
        (F.col("id") % 11).alias("total"), "id",
    )
    w = Window.partitionBy("role").orderBy(F.col("total").desc(), "id")
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    got = K.row_numbers(df, ["role"], [F.col("total").desc(), F.col("id")]).collect()
    assert len(got) == 30000 and all(want[r.id] == r["rank"] for r in got)


def test_row_numbers_do_not_depend_on_partitioning(spark):
    df = spark.range(500).select(F.lit("r").alias("role"), (F.col("id") % 5).alias("total"), "id")
    order = [F.col("total"), F.col("id")]
    runs = [sorted(map(tuple, K.row_numbers(df.repartition(n), ["role"], order).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


def rankings(spark, trials):
    rows = [("s", "r", t, c, i + 1) for t, order in enumerate(trials) for i, c in enumerate(order)]
    return spark.createDataFrame(rows, "study string, role string, trial int, candidate_id string, rank long")


IDS = [f"CAND_{i:03d}" for i in range(100)]


def test_identical_rankings(spark):
    row = S.pair_metrics(rankings(spark, [IDS, IDS])).first()
    assert (row.top_10_jaccard, row.max_rank_shift, row.mean_abs_rank_shift) == (1.0, 0.0, 0.0)
    assert row.kendall_tau == pytest.approx(1.0) and row.spearman_rho == pytest.approx(1.0)


def test_no_common_candidates(spark):
    row = S.pair_metrics(rankings(spark, [IDS, [f"X{i}" for i in range(100)]])).first()
    assert (row.top_10_jaccard, row.newcomer_rate_top_10, row.drop_rate_top_10) == (0.0, 1.0, 1.0)
    assert (row.max_rank_shift, row.mean_abs_rank_shift, row.kendall_tau, row.spearman_rho) == (0.0, 0.0, 0.0, 0.0)


def test_one_candidate_climbs(spark):
    moved = IDS[:4] + [IDS[49]] + IDS[4:49] + IDS[50:]
    row = S.rank_shift(rankings(spark, [IDS, moved])).first()
    assert (row.max_shift, row.mean_shift) == (45.0, 0.9)


def test_single_trial_fails(spark):
    with pytest.raises(Exception, match="at least 2 trials"):
        S.study_stability(rankings(spark, [IDS]), spark.createDataFrame([], "study string, trial int, hp string, value double"))


def test_axis_r2(spark):
    random.seed(3)
    trials = [IDS] + [sorted(IDS, key=lambda c: int(c[5:]) + random.uniform(0, 20 * t)) for t in (1, 2, 3)]
    params = [("s", t, "theta", 0.2 + 0.05 * t) for t in range(4)] + [("s", t, "size", 1000.0) for t in range(4)]
    params = spark.createDataFrame(params, "study string, trial int, hp string, value double")
    r2 = {r.hp: r.r2 for r in S.study_axes(rankings(spark, trials), params).collect()}
    assert r2["size"] == 0.0 and r2["theta"] > 0


def test_inversions_against_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 65, 200):
        p, g = rng.permutation(n), rng.integers(0, 4, n)
        pairs = list(itertools.combinations(range(n), 2))
        assert S.count_inversions(p) == sum(p[i] > p[j] for i, j in pairs)
        assert S.count_inversions(p, g) == sum(p[i] > p[j] and g[i] == g[j] for i, j in pairs)


@pytest.mark.parametrize("block", [7, 16, 1000])
def test_correlation_over_blocks_equals_brute_force(spark, block):
    random.seed(block)
    first, second = IDS[:], IDS[10:] + ["other"]
    random.shuffle(first)
    random.shuffle(second)
    row = S.rank_correlation(rankings(spark, [first, second]), block=block).first()
    shared = [c for c in first if c in second]
    b = [second.index(c) for c in shared]
    signs = [np.sign(y - x) for x, y in itertools.combinations(b, 2)]
    assert row.kendall_tau == pytest.approx(np.mean(signs))
    assert row.spearman_rho == pytest.approx(np.corrcoef(range(len(b)), np.argsort(np.argsort(b)))[0, 1])
