"""Agreement between rankings: top-k overlap, shifts, correlations, and what drives them.

Rankings come as rows (study, role, trial, candidate_id, rank) with rank 1..n per trial.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.runtime import durable

PAIR = ["study", "role", "trial_a", "trial_b"]
# Published soft targets: metric, limit, whether the metric must stay above (True) or below it.
SOFT_TARGETS = [
    ("top_10_jaccard", 0.60, True),
    ("max_rank_shift", 50.0, False),
    ("mean_abs_rank_shift", 15.0, False),
    ("kendall_tau", 0.60, True),
    ("spearman_rho", 0.65, True),
    ("newcomer_rate_top_10", 0.30, False),
]
METRICS = [
    "top_10_jaccard", "top_50_jaccard", "mean_abs_rank_shift",
    "kendall_tau", "spearman_rho", "newcomer_rate_top_10", "drop_rate_top_10",
]
# Rows one task may hold when it counts inversions; larger pools are cut into blocks of this size.
BLOCK = 16384


def trial_pairs(rankings: DataFrame, baseline: int | None = None, bands: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Every pair of trials of a study and role, with the size of each side's top bands."""
    sizes = rankings.groupBy("study", "role", "trial").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in bands]
    )
    a = sizes.select("study", "role", F.col("trial").alias("trial_a"), *[F.col(f"top{k}").alias(f"a{k}") for k in bands])
    b = sizes.select("study", "role", F.col("trial").alias("trial_b"), *[F.col(f"top{k}").alias(f"b{k}") for k in bands])
    return a.join(b, ["study", "role"]).filter(_pair_rule(baseline))


def _pair_rule(baseline: int | None) -> Column:
    if baseline is None:
        return F.col("trial_a") < F.col("trial_b")
    return (F.col("trial_a") == baseline) & (F.col("trial_b") != baseline)


def shared_ranks(rankings: DataFrame, baseline: int | None = None) -> DataFrame:
    """Ranks of the candidates two trials share; the join key is the candidate, so large roles spread."""
    a = rankings.select("study", "role", "candidate_id", F.col("trial").alias("trial_a"), F.col("rank").alias("rank_a"))
    b = rankings.select("study", "role", "candidate_id", F.col("trial").alias("trial_b"), F.col("rank").alias("rank_b"))
    return a.join(b, ["study", "role", "candidate_id"]).filter(_pair_rule(baseline))


def topk_overlap(rankings: DataFrame, k: int, baseline: int | None = None) -> DataFrame:
    """Jaccard of the top-k sets, newcomers as a share of B's and drops as a share of A's top k; 0 when empty."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    band = rankings.filter(F.col("rank") <= k)
    both = shared_ranks(band, baseline).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_i"))
    inter = F.coalesce("_i", F.lit(0))
    a, b = F.col(f"a{k}"), F.col(f"b{k}")
    union = a + b - inter
    return (
        trial_pairs(rankings, baseline, (k,))
        .join(both, PAIR, "left")
        .select(
            *PAIR,
            F.when(union > 0, inter / union).otherwise(F.lit(0.0)).alias("jaccard"),
            F.when(b > 0, (b - inter) / b).otherwise(F.lit(0.0)).alias("newcomer_rate"),
            F.when(a > 0, (a - inter) / a).otherwise(F.lit(0.0)).alias("drop_rate"),
        )
    )


def topk_jaccard(rankings: DataFrame, k: int = 10) -> DataFrame:
    return topk_overlap(rankings, k).select(*PAIR, "jaccard")


def newcomer_drop(rankings: DataFrame, k: int = 10) -> DataFrame:
    return topk_overlap(rankings, k).select(*PAIR, "newcomer_rate", "drop_rate")


def rank_shift(rankings: DataFrame, baseline: int | None = None) -> DataFrame:
    """Largest and mean absolute shift over shared candidates; zeros when none is shared."""
    shift = F.abs(F.col("rank_a") - F.col("rank_b"))
    stats = shared_ranks(rankings, baseline).groupBy(*PAIR).agg(
        F.max(shift).cast("double").alias("_max"), F.avg(shift).alias("_mean")
    )
    return (
        trial_pairs(rankings, baseline)
        .join(stats, PAIR, "left")
        .select(
            *PAIR,
            F.coalesce("_max", F.lit(0.0)).alias("max_shift"),
            F.coalesce("_mean", F.lit(0.0)).alias("mean_shift"),
        )
    )


def _compact(df: DataFrame, rank: str, out: str, block: int) -> DataFrame:
    """Renumber ``rank`` 1..n within a pair, block by block: a block holds at most ``block`` rows."""
    df = df.withColumn("_blk", F.floor((F.col(rank) - 1) / block))
    before = Window.partitionBy(*PAIR).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*PAIR, "_blk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*PAIR, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(Window.partitionBy(*PAIR, "_blk").orderBy(rank))
    return (
        df.withColumn("_local", local)
        .join(offsets, [*PAIR, "_blk"])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_blk", "_local", "_before")
    )


def count_inversions(values: np.ndarray, groups: np.ndarray | None = None) -> int:
    """Pairs (i < j) with values[i] > values[j], within equal ``groups`` when given.

    Two values first differ at one binary digit; per digit, count the ones standing before each zero
    among values that agree on all higher digits.
    """
    values = np.unique(values, return_inverse=True)[1].astype(np.int64)
    base = np.zeros_like(values) if groups is None else np.unique(groups, return_inverse=True)[1].astype(np.int64)
    bits = max(1, int(len(values)).bit_length())
    total = 0
    for bit in range(bits):
        key = (base << bits) | (values >> (bit + 1))
        order = np.argsort(key, kind="stable")
        ones = (values[order] >> bit) & 1
        running = np.cumsum(ones)
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        floor = np.repeat((running - ones)[starts], np.diff(np.r_[starts, len(key)]))
        total += int(((running - floor) * (1 - ones)).sum())
    return total


@F.pandas_udf(T.LongType())
def _row_inversions(b: pd.Series) -> pd.Series:
    return pd.Series([count_inversions(np.asarray(v)) for v in b])


@F.pandas_udf(T.LongType())
def _cross_inversions(a_block: pd.Series, b: pd.Series) -> pd.Series:
    pairs = ((np.asarray(g), np.asarray(v)) for g, v in zip(a_block, b))
    return pd.Series([count_inversions(v) - count_inversions(v, g) for g, v in pairs])


def _discordant(compact: DataFrame, block: int) -> DataFrame:
    """Discordant candidates pairs per trial pair, without pairing candidates.

    Compact ranks fall into a grid of blocks. Pairs sharing an a-block, or else a b-block, are counted
    inside that block (at most ``block`` rows, one Arrow-fed inversion count each). Pairs sharing neither
    depend on the counts of the cells that hold rows: two b-blocks first differ at one binary digit, so per digit and
    prefix above it a running sum over the a-blocks counts the ones that stand before each zero. A running sum spans at
    most the a-blocks, and no table is larger than occupied cells times digits.
    """
    grid = compact.select(
        *PAIR, "ra", "rb",
        F.floor((F.col("ra") - 1) / block).alias("ga"),
        F.floor((F.col("rb") - 1) / block).alias("gb"),
    )
    by_a = (
        grid.groupBy(*PAIR, "ga")
        .agg(F.array_sort(F.collect_list(F.struct("ra", "rb"))).alias("_x"))
        .select(*PAIR, _row_inversions(F.col("_x.rb")).alias("d"))
    )
    by_b = (
        grid.groupBy(*PAIR, "gb")
        .agg(F.array_sort(F.collect_list(F.struct("ra", "rb", "ga"))).alias("_x"))
        .select(*PAIR, _cross_inversions(F.col("_x.ga"), F.col("_x.rb")).alias("d"))
    )
    cells = grid.groupBy(*PAIR, "ga", "gb").agg(F.count(F.lit(1)).alias("n"))
    digits = cells.join(cells.groupBy(*PAIR).agg(F.length(F.bin(F.max("gb"))).alias("_digits")), PAIR).select(
        *PAIR, "ga", "gb", "n", F.explode(F.sequence(F.lit(0), F.col("_digits") - 1)).alias("bit")
    )
    one = F.expr("shiftright(gb, bit) & 1") == 1
    sides = digits.groupBy(*PAIR, "bit", F.expr("shiftright(gb, bit + 1)").alias("prefix"), "ga").agg(
        F.sum(F.when(one, F.col("n")).otherwise(0)).alias("_ones"), F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("_zeros")
    )
    before = Window.partitionBy(*PAIR, "bit", "prefix").orderBy("ga").rowsBetween(Window.unboundedPreceding, -1)
    apart = (
        sides.withColumn("_before", F.coalesce(F.sum("_ones").over(before), F.lit(0)))
        .filter((F.col("_before") > 0) & (F.col("_zeros") > 0))
        .select(*PAIR, (F.col("_before") * F.col("_zeros")).alias("d"))
    )
    parts = reduce(DataFrame.unionByName, [by_a, by_b, apart])
    return parts.groupBy(*PAIR).agg(F.sum("d").alias("discordant"))


def rank_correlation(rankings: DataFrame, baseline: int | None = None, block: int = BLOCK) -> DataFrame:
    """Kendall tau and Spearman rho on shared candidates; zeros with fewer than two.

    Ranks have no ties, so tau = 1 - 4D / n(n-1) with D discordant pairs, and rho follows from the
    squared differences of the ranks renumbered within the shared candidates. The renumbered ranks are
    read four times, so they are made durable once.
    """
    compact = _compact(_compact(shared_ranks(rankings, baseline), "rank_a", "ra", block), "rank_b", "rb", block)
    compact = durable(compact.select(*PAIR, "ra", "rb"))
    gap = (F.col("ra") - F.col("rb")).cast("double")
    n = F.col("_n").cast("double")
    stats = (
        compact.groupBy(*PAIR)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(gap * gap).alias("_d2"))
        .join(_discordant(compact, block), PAIR, "left")
        .filter(F.col("_n") >= 2)
        .select(
            *PAIR,
            (1 - 4 * F.col("discordant") / (n * (n - 1))).alias("_tau"),
            (1 - 6 * F.col("_d2") / (n * (n * n - 1))).alias("_rho"),
        )
    )
    return (
        trial_pairs(rankings, baseline)
        .join(stats, PAIR, "left")
        .select(
            *PAIR,
            F.coalesce("_tau", F.lit(0.0)).alias("kendall_tau"),
            F.coalesce("_rho", F.lit(0.0)).alias("spearman_rho"),
        )
    )


def pair_metrics(rankings: DataFrame, baseline: int | None = None, block: int = BLOCK) -> DataFrame:
    """All agreement metrics of every trial pair in one row; overlap and shift share one self-join."""
    shift = F.abs(F.col("rank_a") - F.col("rank_b"))

    def common(k: int) -> Column:
        return F.count_if((F.col("rank_a") <= k) & (F.col("rank_b") <= k))

    shared = shared_ranks(rankings, baseline).groupBy(*PAIR).agg(
        common(10).alias("i10"), common(50).alias("i50"),
        F.max(shift).cast("double").alias("_max"), F.avg(shift).alias("_mean"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    i10, i50 = F.coalesce("i10", F.lit(0)), F.coalesce("i50", F.lit(0))
    a10, b10, a50, b50 = (F.col(c) for c in ("a10", "b10", "a50", "b50"))
    return (
        trial_pairs(rankings, baseline)
        .join(shared, PAIR, "left")
        .select(
            *PAIR,
            ratio(i10, a10 + b10 - i10).alias("top_10_jaccard"),
            ratio(i50, a50 + b50 - i50).alias("top_50_jaccard"),
            ratio(b10 - i10, b10).alias("newcomer_rate_top_10"),
            ratio(a10 - i10, a10).alias("drop_rate_top_10"),
            F.coalesce("_max", F.lit(0.0)).alias("max_rank_shift"),
            F.coalesce("_mean", F.lit(0.0)).alias("mean_abs_rank_shift"),
        )
        .join(rank_correlation(rankings, baseline, block), PAIR)
    )


def require_trials(rankings: DataFrame, at_least: int = 2) -> DataFrame:
    """Pass the rankings through; the job fails when a study and role has fewer trials."""
    trials = rankings.select("study", "role", "trial").distinct().groupBy("study", "role").agg(
        F.count(F.lit(1)).alias("_t")
    )
    return (
        rankings.join(trials, ["study", "role"])
        .filter(F.assert_true(F.col("_t") >= at_least, F.lit(f"a study needs at least {at_least} trials")).isNull())
        .drop("_t")
    )


def axis_r2(pairs: DataFrame, params: DataFrame) -> DataFrame:
    """Share of the mean shift's variance explained by each hyper-parameter's absolute difference.

    ``pairs``: study, role, trial_a, trial_b, mean_abs_rank_shift; ``params``: study, trial, hp, value. A
    missing value counts as 0; a constant axis or a constant shift explains 0.
    """
    names = params.select("study", "hp").distinct()
    a = params.select("study", "hp", F.col("trial").alias("trial_a"), F.col("value").alias("va"))
    b = params.select("study", "hp", F.col("trial").alias("trial_b"), F.col("value").alias("vb"))
    delta = F.abs(F.coalesce("va", F.lit(0.0)) - F.coalesce("vb", F.lit(0.0)))
    both = F.var_pop("delta") * F.var_pop("mean_abs_rank_shift")
    shared = F.covar_pop("delta", "mean_abs_rank_shift")
    return (
        pairs.join(names, "study")
        .join(a, ["study", "hp", "trial_a"], "left")
        .join(b, ["study", "hp", "trial_b"], "left")
        .withColumn("delta", delta)
        .groupBy("study", "role", "hp")
        .agg(F.round(F.when(both > 0, shared * shared / both).otherwise(F.lit(0.0)), 4).alias("r2"))
    )


def _flags() -> Column:
    checks = []
    for metric, limit, above in SOFT_TARGETS:
        broken = F.col(metric) < limit if above else F.col(metric) > limit
        text = F.format_string(f"{metric}=%.4f {'<' if above else '>'} {limit:.2f}", F.col(metric))
        checks.append(F.when(broken, text))
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def study_stability(rankings: DataFrame, params: DataFrame, block: int = BLOCK) -> DataFrame:
    """Mean agreement over all trial pairs per study and role, with flags and the most explaining axis."""
    pairs = pair_metrics(require_trials(rankings), block=block)
    means = pairs.groupBy("study", "role").agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.round(F.max("max_rank_shift"), 2).alias("max_rank_shift"),
        *[F.round(F.avg(m), 4).alias(m) for m in METRICS],
    )
    top = axis_r2(pairs, params).groupBy("study", "role").agg(
        F.max_by("hp", F.struct("r2", "hp")).alias("top_axis"), F.max("r2").alias("top_axis_r2")
    )
    return means.withColumn("flags", _flags()).join(top, ["study", "role"], "left")


def study_axes(rankings: DataFrame, params: DataFrame) -> DataFrame:
    """R2 of the mean shift per study, role and hyper-parameter."""
    pairs = rank_shift(require_trials(rankings)).withColumnRenamed("mean_shift", "mean_abs_rank_shift")
    return axis_r2(pairs, params)


def baseline_stability(rankings: DataFrame, baseline: int = 0, block: int = BLOCK) -> DataFrame:
    """Every other trial against one baseline: metrics rounded per trial, then averaged per role."""
    pairs = pair_metrics(require_trials(rankings), baseline, block)
    rounded = pairs.select(
        *PAIR, F.round("max_rank_shift", 2).alias("max_rank_shift"), *[F.round(m, 4).alias(m) for m in METRICS]
    )
    return rounded.groupBy("study", "role").agg(
        F.count(F.lit(1)).alias("config_count"),
        F.avg("top_10_jaccard").alias("mean_top_10_jaccard"),
        F.avg("top_50_jaccard").alias("mean_top_50_jaccard"),
        F.max("max_rank_shift").alias("worst_max_rank_shift"),
        F.avg("mean_abs_rank_shift").alias("mean_abs_rank_shift"),
        F.median("mean_abs_rank_shift").alias("median_abs_rank_shift"),
        F.percentile("mean_abs_rank_shift", F.lit(0.95)).alias("p95_abs_rank_shift"),
        F.avg("kendall_tau").alias("kendall_tau"),
        F.avg("spearman_rho").alias("spearman_rho"),
        F.avg("newcomer_rate_top_10").alias("mean_newcomer_rate_top_10"),
        F.avg("drop_rate_top_10").alias("mean_drop_rate_top_10"),
    )


def baseline_axes(rankings: DataFrame, params: DataFrame, baseline: int = 0) -> DataFrame:
    """R2 of the rounded mean shift against each hyper-parameter's distance from the baseline."""
    pairs = rank_shift(rankings, baseline).select(*PAIR, F.round("mean_shift", 4).alias("mean_abs_rank_shift"))
    return axis_r2(pairs, params)


def baseline_alignment(baseline: DataFrame, production: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rank agreement of two scorings of a role, on the candidates both ranked; roles with fewer than two drop out.

    Both inputs: role, candidate_id, rank, total. The span is best minus worst baseline total of its top ten.
    """
    both = baseline.select("role", "candidate_id").join(
        production.select("role", "candidate_id"), ["role", "candidate_id"]
    )
    common = both.groupBy("role").agg(F.count(F.lit(1)).alias("n_common")).filter(F.col("n_common") >= 2)
    rows = baseline.select(F.lit(0).alias("trial"), "role", "candidate_id", "rank").unionByName(
        production.select(F.lit(1).alias("trial"), "role", "candidate_id", "rank")
    ).withColumn("study", F.lit("alignment"))
    span = (
        baseline.filter(F.col("rank") <= 10)
        .groupBy("role")
        .agg((F.max("total") - F.min("total")).alias("top10_span"))
    )
    return (
        common.join(rank_correlation(rows, block=block).select("role", "kendall_tau", "spearman_rho"), "role")
        .join(topk_overlap(rows, 10).select("role", F.col("jaccard").alias("top10_jaccard")), "role")
        .join(span, "role")
    )
