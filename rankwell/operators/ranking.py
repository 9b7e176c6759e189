"""Ordering within groups of any size, and the rank reports built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.runtime import durable, small_side


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based position of every row within its group, without gathering a group in one task.

    Rows are range-partitioned on (group, order), so even a group holding most of the table is spread over many tasks,
    sorted there, and made durable once: positions must stay as they are. A row's place in its partition comes with its
    id; what a group lacks to its rank there is one number per (group, partition), from one small count.
    """
    keys = list(group)
    spread = durable(
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    spread = spread.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        spread.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        .select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    return spread.join(small_side(shifts), [*keys, "_part"]).withColumn(out, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | Column, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark trims each group before the shuffle, so its size does not matter.

    A column ``k`` is trimmed with its own filter: give an upper bound through a constant first when
    groups can be large.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def rank_candidates(totals: DataFrame, top_k: int | None = None) -> DataFrame:
    """Rank per role by total, best first; equal totals keep candidate order.

    ``totals``: role, candidate_id, total (other columns are carried along).
    """
    order = [F.col("total").desc(), F.col("candidate_id")]
    if top_k is not None:
        return top_rows(totals, ["role"], order, top_k)
    return row_numbers(totals, ["role"], order)


def role_summary(totals: DataFrame) -> DataFrame:
    """Per role: candidates, mean total (4 dp), candidates without evidence, and the five best.

    ``totals``: role, candidate_id, total, n_evidence.
    """
    stats = totals.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.round(F.avg("total"), 4).alias("mean_total"),
        F.count_if(F.col("n_evidence") == 0).alias("zero_evidence"),
    )
    best = (
        rank_candidates(totals.select("role", "candidate_id", "total"), top_k=5)
        .groupBy("role")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))).alias("_best"))
        .select("role", F.transform("_best", lambda b: b["candidate_id"]).alias("top_candidates"))
    )
    return stats.join(best, "role", "left")


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, from value counts rather than from single rows.

    Counting equal values first keeps a large group to its distinct values, which for rounded scores and
    small integers is a bounded number.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*group).agg(
        *[F.percentile(value, F.lit(p), F.col("_n")).alias(name) for name, p in points.items()]
    )


def pool_comparison(ranked: DataFrame) -> DataFrame:
    """Each candidate's rank and total against its role's max, mean, median and min.

    ``ranked``: role, candidate_id, total, rank.
    """
    stats = ranked.groupBy("role").agg(
        F.max("total").alias("pool_max"),
        F.avg("total").alias("pool_mean"),
        F.min("total").alias("pool_min"),
        F.count(F.lit(1)).alias("pool_size"),
    )
    # A role none of whose candidates has a total has no median, but is a pool like any other.
    stats = stats.join(exact_percentiles(ranked, ["role"], "total", {"pool_median": 0.5}), "role", "left")
    return ranked.join(small_side(stats), "role")


def _placed(ranked: DataFrame, req_scores: DataFrame) -> DataFrame:
    return req_scores.join(ranked.select("role", "candidate_id", "rank"), ["role", "candidate_id"])


def pool_requirements(ranked: DataFrame, req_scores: DataFrame) -> DataFrame:
    """Own contribution per requirement against the mean of the role's top ten and of the rest.

    ``req_scores``: role, candidate_id, req_id, contribution.
    """
    per_req = _placed(ranked, req_scores).groupBy("role", "req_id").agg(
        F.coalesce(F.avg(F.when(F.col("rank") <= 10, F.col("contribution"))), F.lit(0.0)).alias("top10_mean"),
        F.coalesce(F.avg(F.when(F.col("rank") > 10, F.col("contribution"))), F.lit(0.0)).alias("rest_mean"),
    )
    return req_scores.join(small_side(per_req), ["role", "req_id"])


def pool_cutoffs(ranked: DataFrame, req_scores: DataFrame) -> DataFrame:
    """Per requirement the sum over the first 10, 20 and 50 by the number of candidates, not of rows."""
    sizes = ranked.groupBy("role").agg(F.count(F.lit(1)).alias("_n"))
    return (
        _placed(ranked.filter(F.col("rank") <= 50), req_scores)
        .withColumn("cutoff", F.explode(F.array(F.lit(10), F.lit(20), F.lit(50))))
        .filter(F.col("rank") <= F.col("cutoff"))
        .groupBy("role", "req_id", "cutoff")
        .agg(F.sum("contribution").alias("_sum"))
        .join(sizes, "role")
        .select(
            "role", "req_id", "cutoff",
            (F.col("_sum") / F.least(F.col("cutoff"), F.col("_n"))).alias("mean_contribution"),
        )
    )
