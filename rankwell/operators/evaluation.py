"""Scorer quality: against a judge, by score spread, by verdicts, and as run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.operators.ranking import exact_percentiles, row_numbers
from rankwell.runtime import small_side, tasks_for

FLOOR_LIMIT = 0.25
SUSPECT_PERCENT = 30.0
REVIEW_DELTA = 10.0


def judge_total(judge: DataFrame, weights: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Totals recomputed from judge sub-scores: sum of weight x (sum / n), 4 dp.

    ``judge``: role, candidate_id, req_id, sub_score; ``explicit``: role, candidate_id, req_id, sub_score_sum,
    preferred over the summed scores where present. Requirements the judge left out add nothing. The rows are counted
    first, and grouped and joined in as many tasks as they need.
    """
    keys = ["role", "candidate_id", "req_id"]
    tasks = tasks_for(judge.sparkSession, judge.count())
    sums = judge.repartition(tasks, *keys).groupBy(*keys).agg(F.sum("sub_score").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    if explicit is not None:
        sums = sums.join(explicit.repartition(tasks, *keys), keys, "left").withColumn("_sum", F.coalesce("sub_score_sum", "_sum"))
    return (
        sums.join(small_side(weights.select("role", "req_id", "weight_pct")), ["role", "req_id"])
        .groupBy("role", "candidate_id")
        .agg(F.round(F.sum(F.col("weight_pct") * F.col("_sum") / F.col("_n")), 4).alias("judge_total"))
    )


def scorer_vs_judge(pairs: DataFrame) -> DataFrame:
    """n, MAE, RMSE, R2, bias and largest deviation per role; the null role is all roles together.

    ``pairs``: role, candidate_id, scorer_total, judge_total. R2 is 1 when the judge's totals do not vary.
    """
    error = F.col("scorer_total") - F.col("judge_total")
    spread = F.var_pop("judge_total") * F.count(F.lit(1))
    return (
        pairs.rollup("role")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error * error).alias("_mse"),
            F.avg(error).alias("bias"),
            F.max(F.abs(error)).alias("max_dev"),
            spread.alias("_tot"),
        )
        .select(
            "role", "n",
            F.round("mae", 4).alias("mae"),
            F.round(F.sqrt("_mse"), 4).alias("rmse"),
            F.round(
                F.when(F.col("_tot") > 1e-9, 1 - F.col("_mse") * F.col("n") / F.col("_tot")).otherwise(F.lit(1.0)), 4
            ).alias("r2"),
            F.round("bias", 4).alias("bias"),
            F.round("max_dev", 4).alias("max_dev"),
        )
    )


def per_req_mae(pairs: DataFrame) -> DataFrame:
    """Mean absolute sub-score error per requirement, worst first. ``pairs``: req_id, scorer_sub, judge_sub."""
    return (
        pairs.groupBy("req_id")
        .agg(F.round(F.avg(F.abs(F.col("scorer_sub") - F.col("judge_sub"))), 4).alias("mae"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("mae").desc(), "req_id")
    )


def review_flags(pairs: DataFrame, limit: float = REVIEW_DELTA) -> DataFrame:
    delta = F.col("scorer_total") - F.col("judge_total")
    return pairs.withColumn("delta", F.round(delta, 4)).filter(F.abs("delta") > limit)


def sample_candidates(candidates: DataFrame, pct: float, seed: int = 42) -> DataFrame:
    """Reproducible sample per role of ceil(n x pct) candidates, at least one, in hash order of (seed, id)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("candidate_id").cast("string")))
    placed = row_numbers(candidates.select("role", "candidate_id", key.alias("_h")), ["role"], [F.col("_h"), F.col("candidate_id")], "_pos")
    sizes = candidates.groupBy("role").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * pct)).alias("_take"))
    return placed.join(small_side(sizes), "role").filter(F.col("_pos") <= F.col("_take")).select("role", "candidate_id")


def first_by_source(records: DataFrame) -> DataFrame:
    """One record per role and candidate, from the source with the lowest priority number."""
    others = [c for c in records.columns if c not in ("role", "candidate_id")]
    return (
        records.groupBy("role", "candidate_id")
        .agg(F.min_by(F.struct(*others), F.struct("source_priority", *[c for c in others if c != "source_priority"])).alias("_r"))
        .select("role", "candidate_id", *[F.col(f"_r.{c}").alias(c) for c in others])
    )


def score_variance(totals: DataFrame, req_scores: DataFrame) -> DataFrame:
    """Spread of totals per role and overall (role ``*``), counts beyond two deviations, and the floor rate.

    ``totals``: role, candidate_id, total; ``req_scores``: role, req_id, sub_score. The floor rate is the
    percentage of sub-scores below 0.25.
    """
    scope = F.explode(F.array(F.col("role").cast("string"), F.lit("*"))).alias("scope")
    scoped = totals.select(scope, "total")
    stats = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("total").alias("min_total"),
        F.max("total").alias("max_total"),
        F.avg("total").alias("mean_total"),
        F.coalesce(F.when(F.count(F.lit(1)) > 1, F.var_samp("total")), F.lit(0.0)).alias("variance"),
    ).withColumn("std", F.sqrt("variance"))
    beyond = scoped.join(small_side(stats.select("scope", "mean_total", "std")), "scope").groupBy("scope").agg(
        F.count_if(F.col("total") > F.col("mean_total") + 2 * F.col("std")).alias("n_high"),
        F.count_if(F.col("total") < F.col("mean_total") - 2 * F.col("std")).alias("n_low"),
    )
    floors = req_scores.select(scope, "sub_score").groupBy("scope").agg(
        (100.0 * F.count_if(F.col("sub_score") < FLOOR_LIMIT) / F.count(F.lit(1))).alias("floor_rate")
    )
    return stats.join(beyond, "scope").join(floors, "scope", "left").fillna(0.0, ["floor_rate"])


def suspect_reqs(req_scores: DataFrame, limit: float = SUSPECT_PERCENT) -> DataFrame:
    """Requirements with at least ``limit`` percent of sub-scores below the floor limit, worst first."""
    return (
        req_scores.groupBy("role", "req_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sub_score") < FLOOR_LIMIT).alias("n_floored"))
        .withColumn("floor_rate", 100.0 * F.col("n_floored") / F.col("n"))
        .filter(F.col("floor_rate") >= limit)
        .orderBy(F.col("floor_rate").desc(), "role", "req_id")
    )


def health_thresholds(variance: DataFrame) -> DataFrame:
    """Verdict on the score spread and on the floor rate of :func:`score_variance` rows."""
    return variance.withColumn(
        "spread_health", F.when(F.col("std") < 2, "critical").when(F.col("std") < 5, "warning").otherwise("ok")
    ).withColumn(
        "floor_health",
        F.when(F.col("floor_rate") > 30, "critical").when(F.col("floor_rate") >= 15, "warning").otherwise("ok"),
    )


def req_spread_health(req_scores: DataFrame) -> DataFrame:
    """Requirements whose sub-scores hardly vary (standard deviation below 0.05) cannot tell candidates apart."""
    n = F.count(F.lit(1))
    return (
        req_scores.groupBy("role", "req_id")
        .agg(F.coalesce(F.when(n > 1, F.stddev_samp("sub_score")), F.lit(0.0)).alias("std"))
        .withColumn("health", F.when(F.col("std") < 0.05, "warning").otherwise("ok"))
    )


def rag_eval_rollup(verdicts: DataFrame) -> DataFrame:
    """Judge verdicts per role: share of YES for relevance and faithfulness, mean grade, call counts.

    ``verdicts``: role, task (CR, F, AR), answer, error. A metric without verdicts is null. A grade is the
    first number of the answer, 0.5 when there is none.
    """
    yes = F.when(F.contains(F.upper("answer"), F.lit("YES")), 1.0).otherwise(0.0)
    number = F.regexp_extract("answer", r"(\d+(?:\.\d+)?)", 1)
    grade = F.when(number == "", 0.5).otherwise(number.try_cast("double"))
    value = F.when(F.col("answer").isNotNull(), F.when(F.col("task") == "AR", grade).otherwise(yes))
    tasks = {"CR": "context_relevance", "F": "faithfulness", "AR": "answer_relevance"}
    return (
        verdicts.withColumn("_v", value)
        .groupBy("role")
        .agg(
            *[F.round(F.avg(F.when(F.col("task") == k, F.col("_v"))), 4).alias(name) for k, name in tasks.items()],
            *[F.count(F.when(F.col("task") == k, F.col("_v"))).alias(f"{name}_calls") for k, name in tasks.items()],
        )
    )


def verdict_errors(verdicts: DataFrame) -> DataFrame:
    """Distinct error texts per role with their counts, in text order."""
    return (
        verdicts.filter(F.col("error").isNotNull())
        .groupBy("role", "error")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("role", "error")
    )


ZERO_MESSAGES = {
    "ZERO_NO_EVIDENCE": "no matching text found",
    "ZERO_WRONG_INFERENCE": "text found but LLM did not infer",
}


def zero_diagnostics(sq_scores: DataFrame) -> DataFrame:
    """Zero sub-scores of judged requirements, tagged by whether evidence was found, with a report line.

    ``sq_scores``: role, candidate_id, req_name, sq_key, sub_score, evidence_found, blocked.
    """
    tag = F.when(F.col("evidence_found"), "ZERO_WRONG_INFERENCE").otherwise("ZERO_NO_EVIDENCE")
    message = F.when(F.col("evidence_found"), ZERO_MESSAGES["ZERO_WRONG_INFERENCE"]).otherwise(
        ZERO_MESSAGES["ZERO_NO_EVIDENCE"]
    )
    return (
        sq_scores.filter((F.col("sub_score") <= 0) & ~F.col("blocked"))
        .withColumn("tag", tag)
        .select(
            "role", "candidate_id", "req_name", "sq_key", "tag",
            F.concat(
                F.rpad(F.concat(F.lit("["), "tag", F.lit("]")), 24, " "), F.lit(" "),
                F.concat_ws(" ", F.col("candidate_id").cast("string"), "req_name", "sq_key"), F.lit(" — "), message,
            ).alias("line"),
        )
    )


_LINE = r"^\[(ZERO_NO_EVIDENCE|ZERO_WRONG_INFERENCE)\]\s+(\S+)\s+(\S+)\s+(\S+)"


def parse_diagnostics(lines: DataFrame) -> DataFrame:
    """Report lines back to rows; lines of another shape drop out. ``lines``: role, line."""
    part = [F.regexp_extract(F.trim("line"), _LINE, i) for i in range(1, 5)]
    return lines.select(
        "role", part[0].alias("tag"), part[1].alias("candidate_id"), part[2].alias("req_name"), part[3].alias("sq_key")
    ).filter(F.col("tag") != "")


def report_profile(totals: DataFrame) -> DataFrame:
    """Per role: candidates, min, max, mean, median and sample deviation of the totals."""
    n = F.count(F.lit(1))
    stats = totals.groupBy("role").agg(
        n.alias("n_candidates"),
        F.min("total").alias("min_total"),
        F.max("total").alias("max_total"),
        F.round(F.avg("total"), 4).alias("mean_total"),
        F.round(F.coalesce(F.when(n > 1, F.stddev_samp("total")), F.lit(0.0)), 4).alias("std"),
    )
    return stats.join(exact_percentiles(totals, ["role"], "total", {"median_total": 0.5}), "role")


def report_diagnostics(diags: DataFrame) -> DataFrame:
    """Per role: zero scores by tag and the sub-query most prone to them."""
    per_sq = diags.groupBy("role", "req_name", "sq_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("tag") == "ZERO_NO_EVIDENCE").alias("n_no_evidence"),
        F.count_if(F.col("tag") == "ZERO_WRONG_INFERENCE").alias("n_wrong_inference"),
    )
    label = F.concat("req_name", F.lit(" ("), "sq_key", F.lit(")"))
    return per_sq.withColumn("label", label).groupBy("role").agg(
        F.sum("n_no_evidence").alias("n_no_evidence"),
        F.sum("n_wrong_inference").alias("n_wrong_inference"),
        F.max_by("label", F.struct("n", "label")).alias("most_prone"),
        F.max("n").alias("most_prone_n"),
    )


def calibration_gaps(diags: DataFrame, limit: int = 15) -> DataFrame:
    """Sub-queries with most zero scores among requirements that have wrong inferences."""
    wrong = diags.groupBy("role", "req_name").agg(
        F.count_if(F.col("tag") == "ZERO_WRONG_INFERENCE").alias("n_wrong_inference")
    )
    return (
        diags.groupBy("role", "req_name", "sq_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(wrong.filter(F.col("n_wrong_inference") > 0), ["role", "req_name"])
        .orderBy(F.col("n").desc(), "role", "req_name", "sq_key")
        .limit(limit)
    )


def flagged_cross_reference(flagged: DataFrame, ranked: DataFrame) -> DataFrame:
    """Audit-flagged candidates with their rank and total where scored, critical ones first, worst quality first."""
    return (
        flagged.join(ranked.select("role", "candidate_id", "rank", "total"), ["role", "candidate_id"], "left")
        .withColumn("scored", F.col("rank").isNotNull())
        .orderBy(F.when(F.col("severity") == "CRITICAL", 0).otherwise(1), "quality", "candidate_id")
    )


def top_ten(ranked: DataFrame, flagged: DataFrame, req_scores: DataFrame) -> DataFrame:
    """Ten best per role with audit marker and the requirement lowest in contribution per weight.

    ``req_scores``: role, candidate_id, req_id, contribution, weight_pct.
    """
    gap = F.when(F.col("weight_pct") > 0, F.col("contribution") / F.col("weight_pct"))
    lowest = (
        ranked.filter(F.col("rank") <= 10)
        .join(req_scores.withColumn("_gap", gap), ["role", "candidate_id"], "left")
        .groupBy("role", "candidate_id", "rank", "total")
        .agg(F.min_by("req_id", F.struct("_gap", "req_id")).alias("lowest_req"), F.round(F.min("_gap"), 6).alias("lowest_share"))
    )
    return lowest.join(flagged.select("role", "candidate_id", "severity"), ["role", "candidate_id"], "left")


