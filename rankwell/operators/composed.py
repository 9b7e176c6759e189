"""The composed score from end to end: one row per candidate and requirement, three scorers, committed stages.

The spine of candidates and the requirements of their role splits into requirements scored by code alone, by the judge
on retrieved evidence, and not at all; the three meet again in one table of requirement scores, from which totals and
ranks follow. Every stage of a part of the candidates is a committed table, so that an interrupted run goes on where it
stopped and nobody is scored twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions import matching as M
from rankwell.operators.identity import unscored
from rankwell.operators.matching import code_only_req_score
from rankwell.operators.ranking import rank_candidates
from rankwell.operators.retrieval import cosine_scores, union_dedup_topk
from rankwell.operators.scoring import CODE_ONLY_TYPES, REQ, apply_block_rules, composed_total, score_judge_responses
from rankwell.runtime import is_committed, small_side

SCORE = [*REQ, "branch", "reason", "blocked", "sub_score_sum", "contribution"]


@dataclass(frozen=True)
class Inputs:
    """Tables of a run. ``candidates``: role, candidate_id, raw_text, grade; ``requirements``: role, req_id, category,
    req_name, weight_pct, expected_years; ``sub_queries``: role, req_id, sq_pos, sq_key, sq_text, kind, query (a vector,
    null for requirements scored by code alone); ``chunks``: role, candidate_id, chunk_id, embedding; ``responses``: role,
    candidate_id, req_id, response; ``tenure``: role, candidate_id, total_months; the others as in
    :func:`rankwell.operators.matching.code_only_req_score`.
    """

    candidates: DataFrame
    requirements: DataFrame
    sub_queries: DataFrame
    chunks: DataFrame
    responses: DataFrame
    tenure: DataFrame
    degrees: DataFrame
    certs: DataFrame
    institutes: DataFrame
    providers: DataFrame


def target_years(requirements: DataFrame, sub_queries: DataFrame) -> DataFrame:
    """(role, req_id, target_years): the number of years a requirement expects, null if it names none.

    The first sub-query that speaks of years and states a number gives it; a number in the requirement's own
    ``expected_years`` goes before that. Where both are missing or 0, the name decides (``5+ years of ...``).
    """
    stated = sub_queries.where(F.contains(F.lower("sq_text"), F.lit("years"))).select(
        "role", "req_id", "sq_pos", M.expected_years(F.col("sq_text")).alias("y")
    )
    asked = stated.where("y IS NOT NULL").groupBy("role", "req_id").agg(F.min_by("y", "sq_pos").alias("asked"))
    named = F.nullif(F.regexp_extract("req_name", r"(?i)(\d+)\+?\s*years?", 1), F.lit("")).cast("double")
    known = F.coalesce(F.col("expected_years").cast("string").try_cast("double"), F.col("asked"))
    return requirements.join(asked, ["role", "req_id"], "left").select(
        "role", "req_id", F.when(F.coalesce(known, F.lit(0.0)) == 0, F.coalesce(named, known)).otherwise(known).alias("target_years")
    )


def typed(requirements: DataFrame) -> DataFrame:
    return requirements.withColumn("req_type", M.requirement_type(F.col("category"), F.col("req_name")))


def _by_code(requirements: DataFrame) -> DataFrame:
    return typed(requirements).where(F.col("req_type").isin(*CODE_ONLY_TYPES)).select("role", "req_id", "req_name", "weight_pct")


def _of(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    return rows.join(candidates.select("role", "candidate_id"), ["role", "candidate_id"], "left_semi")


def find_evidence(inputs: Inputs, candidates: DataFrame) -> DataFrame:
    """(role, candidate_id, req_id, n_evidence): requirements of the candidates for which chunks were retrieved."""
    asked = inputs.sub_queries.join(_by_code(inputs.requirements), ["role", "req_id"], "left_anti").where("query IS NOT NULL")
    hits = union_dedup_topk(cosine_scores(_of(inputs.chunks, candidates), asked), asked)
    return hits.groupBy(*REQ).agg(F.count(F.lit(1)).alias("n_evidence"))


def judge(inputs: Inputs, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sub-query scores from the judge's answers, for requirements with evidence only."""
    asked = inputs.sub_queries.join(small_side(target_years(inputs.requirements, inputs.sub_queries)), ["role", "req_id"])
    answered = _of(inputs.responses, candidates).join(evidence, REQ, "left_semi")
    return score_judge_responses(answered, asked, _of(inputs.tenure, candidates))


def score_by_code(inputs: Inputs, candidates: DataFrame) -> DataFrame:
    own = inputs.sub_queries.select("role", "req_id", "sq_key", "sq_text", "kind").join(_by_code(inputs.requirements), ["role", "req_id"])
    full = _of(inputs.candidates, candidates)
    return code_only_req_score(full, own, _of(inputs.degrees, candidates), _of(inputs.certs, candidates), inputs.institutes, inputs.providers)


def meet(inputs: Inputs, candidates: DataFrame, evidence: DataFrame, judged: DataFrame, coded: DataFrame) -> DataFrame:
    """Columns SCORE, one row per candidate and requirement of its role.

    ``branch`` tells who scored (code or judge; null if blocked). Without sub-queries, and without evidence where it is
    needed, a requirement is blocked with 0; evidence without an answer gets the floor for every sub-query.
    """
    weights = typed(inputs.requirements).select("role", "req_id", "weight_pct", "req_type")
    n = inputs.sub_queries.groupBy("role", "req_id").agg(F.count(F.lit(1)).alias("_n"))
    code = _by_code(inputs.requirements).join(n, ["role", "req_id"], "left_semi")
    rest = weights.join(code, ["role", "req_id"], "left_anti")
    judged_rows = apply_block_rules(candidates.select("role", "candidate_id"), rest, inputs.sub_queries, evidence, judged)
    none = F.lit(None).cast("string")
    return judged_rows.withColumn("branch", F.when(~F.col("blocked"), "judge")).select(*SCORE).unionByName(
        coded.select(*REQ, F.lit("code").alias("branch"), none.alias("reason"), F.lit(False).alias("blocked"), "sub_score_sum", "contribution")
    )


def composed_requirements(spark: SparkSession, inputs: Inputs, folder: str, run_id: str, parts: int = 1) -> DataFrame:
    """Requirement scores of all candidates (columns SCORE), through committed stages under ``folder``.

    Candidates whom the run has not scored are dealt by hash into ``parts``; a part's candidates, evidence, judge scores,
    code scores and requirement scores are five tables, each computed only if its commit is missing. A run that was
    stopped is started again with the same arguments: complete tables are read, the first incomplete one is written
    anew. Candidates who joined since make up further parts. Give each run its own ``run_id`` and run it once at a time.
    """
    base = f"{folder.rstrip('/')}/{run_id}"

    def kept(path: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not is_committed(spark, path):
            build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def score(at: str) -> DataFrame:
        mine = spark.read.parquet(f"{at}/candidates")
        evidence = kept(f"{at}/evidence", lambda: find_evidence(inputs, mine))
        judged = kept(f"{at}/judged", lambda: judge(inputs, mine, evidence))
        coded = kept(f"{at}/coded", lambda: score_by_code(inputs, mine))
        return kept(f"{at}/scores", lambda: meet(inputs, mine, evidence, judged, coded))

    done: list[DataFrame] = []
    pool = inputs.candidates.select("role", "candidate_id").distinct()
    ledger = lambda: [d.select(F.lit(run_id).alias("run_id"), "role", "candidate_id") for d in done]

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    while is_committed(spark, f"{base}/part={len(done)}/candidates"):
        done.append(score(f"{base}/part={len(done)}"))
    left = parts - len(done) if len(done) < parts else 1
    for k in range(left):
        todo = unscored(pool, union(ledger()), run_id) if done else pool
        if k < left - 1:
            todo = todo.where(F.pmod(F.xxhash64("role", "candidate_id"), F.lit(parts)) == len(done))
        elif len(done) >= parts and todo.isEmpty():
            break
        at = f"{base}/part={len(done)}"
        kept(f"{at}/candidates", lambda: todo)
        done.append(score(at))
    return union(done)


def composed_pipeline(spark: SparkSession, inputs: Inputs, folder: str, run_id: str, parts: int = 1) -> DataFrame:
    """(role, candidate_id, total, rank, n_blocked, n_failed) from the committed requirement scores."""
    scores = composed_requirements(spark, inputs, folder, run_id, parts)
    counts = scores.groupBy("role", "candidate_id").agg(
        F.count_if("blocked").alias("n_blocked"), F.count_if(F.coalesce(F.col("reason") == "scoring_failed", F.lit(False))).alias("n_failed")
    )
    return rank_candidates(composed_total(scores)).join(counts, ["role", "candidate_id"])
