"""From sub-query scores to requirement contributions and candidate totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.functions.bands import (
    YEARS_PHRASES, binary_score, has_any, is_years_subquery, qualitative_band, subquery_kind, years_band,
)
from rankwell.functions.core import let
from rankwell.runtime import small_side

REQ = ["role", "candidate_id", "req_id"]
FLOOR = 0.01
# Sums and contributions are exact: scores below 10,000 and weights below 100,000 count to nine places.
SCORE, WEIGHT = "decimal(13,9)", "decimal(14,9)"


def _contribution(total: Column, n: Column) -> Column:
    """``_weight`` x total / n in decimals, halves away from zero at 4 dp: the same in every order of the rows."""
    return F.round(F.col("_weight") * total / n, 4).cast("double")


def classify_subqueries(sub_queries: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``is_years``. Input: sq_key, sq_text, sq_type, scale, method."""
    return sub_queries.withColumn("kind", subquery_kind(F.col("sq_text"), F.col("sq_key"), F.col("sq_type"))).withColumn(
        "is_years", is_years_subquery(F.col("sq_text"), F.col("scale"), F.col("method"))
    )


def req_scores(sq_scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of sub-scores and contribution = round(weight x sum / n, 4) per candidate and requirement.

    ``sq_scores``: role, candidate_id, req_id, sub_score; ``weights``: role, req_id, weight_pct.
    """
    sums = sq_scores.groupBy(*REQ).agg(F.sum(F.col("sub_score").cast(SCORE)).alias("_sum"), F.count(F.lit(1)).alias("n_sq"))
    weighed = weights.select("role", "req_id", "weight_pct", F.col("weight_pct").cast(WEIGHT).alias("_weight"))
    return sums.join(small_side(weighed), ["role", "req_id"]).select(
        "role", "req_id", "candidate_id", F.col("_sum").cast("double").alias("sub_score_sum"), "n_sq", "weight_pct",
        _contribution(F.col("_sum"), F.col("n_sq")).alias("contribution"),
    )


def composed_total(reqs: DataFrame) -> DataFrame:
    return reqs.groupBy("role", "candidate_id").agg(F.round(F.sum("contribution"), 4).alias("total"))


# The requirement types that are scored without retrieved evidence.
CODE_ONLY_TYPES = ("education", "certification", "location")


def apply_block_rules(
    candidates: DataFrame, weights: DataFrame, sub_queries: DataFrame, evidence: DataFrame, sq_scores: DataFrame
) -> DataFrame:
    """Requirement scores of every candidate of a role, with the blocking rules.

    No sub-queries: blocked, zero. No evidence: blocked, zero, flagged. No scores despite evidence: the
    scorer failed and each sub-query gets the floor. ``candidates``: role, candidate_id; ``sub_queries``:
    role, req_id, sq_key; ``evidence``: role, candidate_id, req_id (one row per chunk). Requirements of a type that is
    scored by code alone need no evidence: where ``weights`` has a ``req_type``, the evidence rule passes them over.
    """
    n_sq = sub_queries.groupBy("role", "req_id").agg(F.count(F.lit(1)).alias("n_sq"))
    n_ev = evidence.groupBy(*REQ).agg(F.count(F.lit(1)).alias("n_evidence"))
    sums = sq_scores.groupBy(*REQ).agg(F.sum(F.col("sub_score").cast(SCORE)).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    weights = weights.withColumn("_weight", F.col("weight_pct").cast(WEIGHT))
    rows = (
        candidates.join(small_side(weights.join(n_sq, ["role", "req_id"], "left")), "role")
        .join(n_ev, REQ, "left")
        .join(sums, REQ, "left")
    )
    by_code = F.coalesce(F.col("req_type").isin(*CODE_ONLY_TYPES), F.lit(False)) if "req_type" in weights.columns else F.lit(False)
    reason = (
        F.when(F.col("n_sq").isNull(), "no_sub_queries")
        .when(F.col("n_evidence").isNull() & ~by_code, "no_evidence")
        .when(F.col("_n").isNull(), "scoring_failed")
    )
    blocked = F.col("reason").isin("no_sub_queries", "no_evidence")
    failed = F.col("reason") == "scoring_failed"
    return (
        rows.withColumn("reason", reason)
        .withColumn("blocked", F.coalesce(blocked, F.lit(False)))
        .withColumn(
            "sub_score_sum",
            F.when(F.col("blocked"), 0.0).when(failed, FLOOR * F.col("n_sq")).otherwise(F.col("_sum").cast("double")),
        )
        .withColumn(
            "contribution",
            F.when(F.col("blocked"), 0.0)
            .when(failed, _contribution(F.lit(FLOOR).cast(SCORE), F.lit(1)))
            .otherwise(_contribution(F.col("_sum"), F.col("_n"))),
        )
        .select(*REQ, "reason", "blocked", "sub_score_sum", "contribution")
    )


def lacking_evidence(candidates: DataFrame, weights: DataFrame, sub_queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """The rows of ``apply_block_rules`` with reason ``no_evidence``, without their scores, which nothing is read for."""
    asked = weights.join(sub_queries.select("role", "req_id").distinct(), ["role", "req_id"], "left_semi")
    if "req_type" in weights.columns:
        asked = asked.where(~F.coalesce(F.col("req_type").isin(*CODE_ONLY_TYPES), F.lit(False)))
    rows = candidates.join(small_side(asked.select("role", "req_id")), "role").join(evidence, REQ, "left_anti")
    return rows.select(*REQ, F.lit("no_evidence").alias("reason"))


def no_evidence_flags(
    blocked: DataFrame, requirements: DataFrame, sub_queries: DataFrame, as_of: str, theta: float | None, chunker: str = "Recursive"
) -> DataFrame:
    """Flag rows for requirements blocked for lack of evidence, stamped with the run's time.

    ``requirements``: role, req_id, req_name; ``sub_queries``: role, req_id, sq_key. A row names the requirement, the
    sub-queries that found nothing and their number, the retrieval threshold and the chunker.
    """
    keys = sub_queries.groupBy("role", "req_id").agg(F.array_sort(F.collect_set("sq_key")).alias("sub_query_keys"))
    named = requirements.select("role", "req_id", F.col("req_name").alias("requirement_name")).join(keys, ["role", "req_id"], "left")
    flags = blocked.filter(F.col("reason") == "no_evidence").select(*REQ).join(small_side(named), ["role", "req_id"], "left")
    asked = F.coalesce("sub_query_keys", F.array().cast("array<string>"))
    return flags.select(
        *REQ, F.lit("no_evidence").alias("flag_type"), F.lit(as_of).cast("timestamp").alias("timestamp"), "requirement_name",
        asked.alias("sub_query_keys"), F.size(asked).alias("sub_query_count"),
        F.round(F.lit(theta).cast("double"), 4).alias("theta"), F.lit(chunker).alias("chunker"),
    )


JUDGE_SCHEMA = T.StructType([
    T.StructField("sub_scores", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("sub_score", T.StringType()),
        T.StructField("evidence_found", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("extracted_years", T.StringType()),
    ]))),
])


def parse_years(raw: Column) -> Column:
    """Years as a number from ``3``, ``"~2.5 yrs"``, ``"3+"``; null when there is no number."""
    text = F.regexp_replace(F.trim(raw), r"^[~<>≈≥≤+\-]+", "")
    text = F.regexp_replace(F.trim(text), r"(?i)\s*(years?|yrs?|y)\s*$", "")
    return let(
        F.regexp_replace(text, r"[^0-9.]+$", ""),
        lambda t: F.coalesce(
            t.try_cast("double"), F.when(t != "", F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1).try_cast("double"))
        ),
    )


def _answer_score(sq: Column, answers: Column, tenure_years: Column) -> Column:
    """struct(sq_key, kind, sub_score) of one sub-query from the response's answers, before the rescue."""

    def banded(a: Column) -> Column:
        return let(
            F.struct(parse_years(a["extracted_years"]).alias("y")),
            lambda p: F.when(p["y"].isNotNull(), years_band(p["y"], sq["target_years"])).otherwise(qualitative_band(a["level"])),
        )

    def from_answer(a: Column) -> Column:
        given = F.coalesce(a["sub_score"].try_cast("double"), F.lit(0.0))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))
        found = F.lower(F.trim(F.coalesce(a["evidence_found"], F.lit("")))) == "yes"
        return (
            F.when(a.isNull(), FLOOR)
            .when(sq["kind"] == "binary", binary_score((score >= 0.5) | found))
            .when(sq["kind"] == "four_band", banded(a))
            .otherwise(score)
        )

    asks_years = (sq["target_years"] > 0) & (tenure_years > 0) & has_any(F.lower(sq["sq_text"]), YEARS_PHRASES)
    answer = F.try_element_at(F.filter(answers, lambda a: a["key"] == sq["sq_key"]), F.lit(-1))
    value = F.when(asks_years, years_band(tenure_years, sq["target_years"])).otherwise(let(answer, from_answer))
    return F.struct(sq["sq_key"].alias("sq_key"), sq["kind"].alias("kind"), value.alias("sub_score"))


def score_judge_responses(
    responses: DataFrame, sub_queries: DataFrame, tenure: DataFrame | None = None
) -> DataFrame:
    """Sub-query scores from judge answers, one JSON text per candidate and requirement.

    ``responses``: role, candidate_id, req_id, response; ``sub_queries``: role, req_id, sq_key, sq_text, kind,
    target_years; ``tenure``: role, candidate_id, total_months. Of repeated keys the last answer counts. Unknown keys drop out and missing keys, like a
    response that does not parse, get the floor. Years questions take the computed tenure when a target is set.
    A passed binary gate lifts a floored four-band score to 0.25. A response is scored within its row against
    the short list of its requirement's sub-queries, so responses are not regrouped.
    """
    asked = sub_queries.groupBy("role", "req_id").agg(
        F.array_sort(F.collect_list(F.struct("sq_key", "sq_text", "kind", "target_years"))).alias("_sq")
    )
    rows = responses.join(small_side(asked), ["role", "req_id"])
    if tenure is None:
        rows = rows.withColumn("_years", F.lit(None).cast("double"))
    else:
        rows = rows.join(tenure, ["role", "candidate_id"], "left").withColumn("_years", F.round(F.col("total_months") / 12, 2))
    answers = F.coalesce(F.from_json("response", JUDGE_SCHEMA)["sub_scores"], F.array().cast(JUDGE_SCHEMA["sub_scores"].dataType))
    scored = let(
        answers, lambda a: F.transform("_sq", lambda sq: _answer_score(sq, a, F.col("_years")))
    )

    def rescue(results: Column) -> Column:
        gate = F.exists(results, lambda r: (r["kind"] == "binary") & (r["sub_score"] >= 0.5))
        return let(
            gate,
            lambda g: F.transform(
                results,
                lambda r: F.struct(
                    r["sq_key"].alias("sq_key"),
                    F.when(g & (r["kind"] == "four_band") & (r["sub_score"] <= FLOOR), 0.25).otherwise(r["sub_score"]).alias("sub_score"),
                ),
            ),
        )

    return rows.select(*REQ, F.explode(let(scored, rescue)).alias("_r")).select(*REQ, "_r.sq_key", "_r.sub_score")


def graded_items(items: DataFrame) -> DataFrame:
    """Importance-graded item scores: nothing, 30 % for a mention, or the share of expected years.

    ``items``: candidate_id, category, item, matched, years, importance, normalized_importance, expected_years.
    """
    importance = F.when(F.coalesce("importance", F.lit(10.0)) == 0, 10.0).otherwise(F.coalesce("importance", F.lit(10.0)))
    ratio = F.least(F.lit(1.0), F.col("years") / F.greatest(F.col("expected_years"), F.lit(1e-9)))
    return (
        items.withColumn("importance", importance)
        .withColumn(
            "raw_score",
            F.when(~F.col("matched"), 0.0)
            .when(F.col("years") <= 0, F.round(F.col("importance") * 0.3, 2))
            .otherwise(F.round(F.col("importance") * ratio, 2)),
        )
        .withColumn(
            "score",
            F.round(
                F.col("raw_score") * F.coalesce("normalized_importance", "importance") / F.col("importance"), 2
            ),
        )
    )


def graded_total(items: DataFrame, scale: float) -> DataFrame:
    """Category sums and a row per candidate with its total = sum of raw x scale.

    Only the candidate's row has a ``total``; its category is null, as is that of items without one.
    """
    return (
        graded_items(items)
        .groupingSets([["candidate_id", "category"], ["candidate_id"]], "candidate_id", "category")
        .agg(
            F.grouping("category").alias("_all"),
            F.sum("raw_score").alias("raw_score"),
            F.sum("importance").alias("max_score"),
            F.sum("score").alias("score"),
        )
        .filter(F.col("candidate_id").isNotNull())
        .withColumn("total", F.when(F.col("_all") == 1, F.round(F.col("raw_score") * scale, 2)))
        .drop("_all")
    )


def is_years_requirement(category, name):
    blob = F.lower(F.concat_ws(" ", category, name))
    return ~has_any(blob, ["education", "certification", "location"]) & has_any(
        blob, ["experience", "years", "tenure", "senior"]
    )


def code_only_v2(items: DataFrame) -> DataFrame:
    """Contribution without a judge: years requirements by share of the target, others by match.

    ``items``: candidate_id, req_id, category, req_name, weight_pct, expected_years, matched, years. A years
    requirement without target is blocked; a match without measured years counts 0.3.
    """
    is_years = is_years_requirement(F.col("category"), F.col("req_name"))
    share = F.round(F.least(F.col("years") / F.col("expected_years"), F.lit(1.0)), 4)
    part = (
        F.when(F.col("blocked") | ~F.col("matched"), 0.0)
        .when(is_years & (F.col("years") > 0) & (F.col("expected_years") > 0), share)
        .when(is_years, 0.3)
        .otherwise(1.0)
    )
    return (
        items.withColumn("blocked", is_years & F.col("expected_years").isNull())
        .withColumn("code_only_part", part)
        .withColumn(
            "contribution",
            F.when(F.col("blocked"), 0.0).otherwise(F.round(F.col("weight_pct") * F.col("code_only_part"), 4)),
        )
    )


def code_only_v2_total(items: DataFrame) -> DataFrame:
    return code_only_v2(items).groupBy("candidate_id").agg(
        F.round(F.sum("contribution"), 4).alias("total"), F.count_if("blocked").alias("n_blocked")
    )


def unified_total(items: DataFrame, scale: float) -> DataFrame:
    """Category-config total: education = match x tier x flag penalty, certification = match x tier,
    location = match, anything else the judged score; total = round(sum of raw x scale, 2).

    ``items``: candidate_id, dimension, importance, matched, tier_points, flagged, judged (share of importance).
    """
    gate = binary_score(F.col("matched"))
    points = F.coalesce("tier_points", F.lit(0.5))
    raw = (
        F.when(
            F.col("dimension") == "education",
            gate * points * F.col("importance") * F.when(F.col("flagged"), 0.5).otherwise(1.0),
        )
        .when(F.col("dimension") == "certification", gate * points * F.col("importance"))
        .when(F.col("dimension") == "location", gate * F.col("importance"))
        .otherwise(F.coalesce("judged", F.lit(0.0)) * F.col("importance"))
    )
    return (
        items.withColumn("raw_score", F.round(raw, 2))
        .groupBy("candidate_id")
        .agg(F.sum("raw_score").alias("total_raw"), F.sum("importance").alias("total_max"))
        .withColumn("total", F.round(F.col("total_raw") * scale, 2))
    )
