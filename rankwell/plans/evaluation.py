"""Registered queries: evaluation and health metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import evaluation as V, ranking as K
from rankwell.plans.catalog import Tables, query, view
from rankwell.plans.scoring import req_scores, totals

# The judge sees the same line items with the tax taken off; a requirement with a single line has an explicit sum.
view(
    "judge_scores",
    """SELECT l_returnflag AS role, l_orderkey AS candidate_id, l_linenumber AS req_id,
              round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), l_discount * 10 - l_tax * 4)), 4) AS sub_score FROM {lineitem}""",
)
view(
    "judge_explicit",
    """SELECT l_returnflag AS role, l_orderkey AS candidate_id, l_linenumber AS req_id, max(l_quantity) / 50 AS sub_score_sum
       FROM {lineitem} GROUP BY l_returnflag, l_orderkey, l_linenumber HAVING count(*) = 1 AND max(l_quantity) > 25""",
)
# The judge's own weighting, a little apart from the scorer's.
view("judge_weights", "SELECT role, req_id, weight_pct * CAST(0.98765432 AS DOUBLE) AS weight_pct FROM {line_weights}")
view(
    "judge_totals_o", spark="SELECT 1",
    oracle="""SELECT j.role, j.candidate_id, round(sum(weight_pct * coalesce(sub_score_sum, s) / n), 4) AS judge_total
       FROM (SELECT role, candidate_id, req_id, sum(sub_score) AS s, count(*) AS n FROM {judge_scores} GROUP BY ALL) j
       JOIN {judge_weights} w ON j.role = w.role AND j.req_id = w.req_id
       LEFT JOIN {judge_explicit} e ON e.role = j.role AND e.candidate_id = j.candidate_id AND e.req_id = j.req_id
       GROUP BY j.role, j.candidate_id""",
)
view(
    "judge_pairs_o", spark="SELECT 1",
    oracle="""SELECT t.role, t.candidate_id, t.total AS scorer_total, j.judge_total
       FROM {totals_o} t JOIN {judge_totals_o} j ON t.role = j.role AND t.candidate_id = j.candidate_id""",
)


def judge_totals(t: Tables):
    return V.judge_total(t.judge_scores, t.judge_weights, t.judge_explicit)


def judge_pairs(t: Tables):
    return totals(t).withColumnRenamed("total", "scorer_total").join(judge_totals(t), ["role", "candidate_id"])


@query("judge_total", "SELECT * FROM {judge_totals_o}")
def _(t: Tables):
    return judge_totals(t)


@query(
    "scorer_vs_judge",
    """SELECT role, count(*) AS n, round(avg(abs(scorer_total - judge_total)), 4) AS mae,
              round(sqrt(avg(pow(scorer_total - judge_total, 2))), 4) AS rmse,
              round(1 - sum(pow(scorer_total - judge_total, 2)) / (var_pop(judge_total) * count(*)), 4) AS r2,
              round(avg(scorer_total - judge_total), 4) AS bias, round(max(abs(scorer_total - judge_total)), 4) AS max_dev
       FROM {judge_pairs_o} GROUP BY ROLLUP (role)""",
)
def _(t: Tables):
    return V.scorer_vs_judge(judge_pairs(t))


@query(
    "per_req_mae",
    """SELECT a.req_id, round(avg(abs(a.sub_score_sum - b.s)), 4) AS mae, count(*) AS n
       FROM {req_scores_o} a JOIN (SELECT role, candidate_id, req_id, sum(sub_score) AS s FROM {judge_scores} GROUP BY ALL) b
         ON a.role = b.role AND a.candidate_id = b.candidate_id AND a.req_id = b.req_id GROUP BY a.req_id""",
)
def _(t: Tables):
    keys = ["role", "candidate_id", "req_id"]
    judged = t.judge_scores.groupBy(*keys).agg(F.sum("sub_score").alias("judge_sub"))
    return V.per_req_mae(req_scores(t).withColumnRenamed("sub_score_sum", "scorer_sub").join(judged, keys))


@query(
    "review_flags",
    """SELECT role, candidate_id, scorer_total, judge_total, round(scorer_total - judge_total, 4) AS delta
       FROM {judge_pairs_o} WHERE abs(round(scorer_total - judge_total, 4)) > 10""",
)
def _(t: Tables):
    return V.review_flags(judge_pairs(t))


@query(
    "sample_candidates",
    """SELECT role, candidate_id FROM (
         SELECT *, row_number() OVER (PARTITION BY role ORDER BY md5('42:' || candidate_id), candidate_id) AS pos,
                greatest(1, ceil(count(*) OVER (PARTITION BY role) * 0.05)) AS take FROM {line_candidates}) x WHERE pos <= take""",
)
def _(t: Tables):
    return V.sample_candidates(t.line_candidates, 0.05)


# Candidate files come first, the ranked file (recomputed by the judge) fills the gaps.
view(
    "file_records",
    """SELECT l_returnflag AS role, l_orderkey AS candidate_id, 1 AS source_priority, round(sum(l_discount) * 10, 2) AS total
       FROM {lineitem} WHERE l_tax > 0.03 GROUP BY l_returnflag, l_orderkey
       UNION ALL SELECT l_returnflag, l_orderkey, 2, round(sum(l_discount) * 12, 2)
       FROM {lineitem} GROUP BY l_returnflag, l_orderkey""",
)
view(
    "variance_o", spark="SELECT 1",
    oracle="""WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role, candidate_id ORDER BY source_priority) AS pick
                    FROM {file_records}) x WHERE pick = 1),
       scoped AS (SELECT role AS scope, total FROM first UNION ALL SELECT '*', total FROM first),
       stats AS (SELECT scope, count(*) AS n, min(total) AS min_total, max(total) AS max_total, avg(total) AS mean_total,
                        coalesce(var_samp(total), 0) AS variance, coalesce(stddev_samp(total), 0) AS std FROM scoped GROUP BY scope),
       subs AS (SELECT role AS scope, sub_score FROM {sq_scores} UNION ALL SELECT '*', sub_score FROM {sq_scores})
       SELECT s.*, n_high, n_low, floor_rate FROM stats s
       JOIN (SELECT c.scope, count(*) FILTER (WHERE total > mean_total + 2 * std) AS n_high,
                    count(*) FILTER (WHERE total < mean_total - 2 * std) AS n_low
             FROM scoped c JOIN stats s ON c.scope = s.scope GROUP BY c.scope) b ON s.scope = b.scope
       JOIN (SELECT scope, 100.0 * count(*) FILTER (WHERE sub_score < 0.25) / count(*) AS floor_rate FROM subs GROUP BY scope) f
         ON s.scope = f.scope""",
)


def variance(t: Tables):
    return V.score_variance(V.first_by_source(t.file_records), t.sq_scores)


_V4 = "round(mean_total, 4) AS mean_total, round(variance, 4) AS variance, round(std, 4) AS std, round(floor_rate, 4) AS floor_rate"


def _v4(df):
    for c in ("mean_total", "variance", "std", "floor_rate"):
        df = df.withColumn(c, F.round(c, 4))
    return df


@query("score_variance", f"SELECT scope, n, min_total, max_total, n_high, n_low, {_V4} FROM {{variance_o}}")
def _(t: Tables):
    return _v4(variance(t))


@query(
    "suspect_reqs",
    """SELECT role, req_id, n, n_floored, round(100.0 * n_floored / n, 6) AS floor_rate FROM (
         SELECT role, req_id, count(*) AS n, count(*) FILTER (WHERE sub_score < 0.25) AS n_floored FROM {sq_scores} GROUP BY ALL) x
       WHERE 100.0 * n_floored / n >= 25""",
)
def _(t: Tables):
    return V.suspect_reqs(t.sq_scores, limit=25.0).withColumn("floor_rate", F.round("floor_rate", 6))


@query(
    "health_thresholds",
    f"""SELECT scope, n, min_total, max_total, n_high, n_low, {_V4},
          CASE WHEN std < 2 THEN 'critical' WHEN std < 5 THEN 'warning' ELSE 'ok' END AS spread_health,
          CASE WHEN floor_rate > 30 THEN 'critical' WHEN floor_rate >= 15 THEN 'warning' ELSE 'ok' END AS floor_health
        FROM {{variance_o}}""",
)
def _(t: Tables):
    return _v4(V.health_thresholds(variance(t)))


@query(
    "req_spread_health",
    """SELECT role, req_id, round(stddev_samp(sub_score), 6) AS std,
              CASE WHEN stddev_samp(sub_score) < 0.05 THEN 'warning' ELSE 'ok' END AS health FROM {sq_scores} GROUP BY role, req_id""",
)
def _(t: Tables):
    return V.req_spread_health(t.sq_scores).withColumn("std", F.round("std", 6))


# A conversation turn is a verdict; its place in the conversation tells the task. Short turns stand for failed calls.
view(
    "verdicts",
    """SELECT role, CASE turn % 3 WHEN 0 THEN 'CR' WHEN 1 THEN 'F' ELSE 'AR' END AS task,
              CASE WHEN length(text) >= 60 THEN text END AS answer,
              CASE WHEN length(text) < 60 THEN concat('HTTP ', CAST(400 + length(text) AS STRING)) END AS error FROM {conversations}""",
)


@query(
    "rag_eval_rollup",
    """SELECT role, round(avg(v) FILTER (WHERE task = 'CR'), 4) AS context_relevance, round(avg(v) FILTER (WHERE task = 'F'), 4) AS faithfulness,
              round(avg(v) FILTER (WHERE task = 'AR'), 4) AS answer_relevance, count(v) FILTER (WHERE task = 'CR') AS context_relevance_calls,
              count(v) FILTER (WHERE task = 'F') AS faithfulness_calls, count(v) FILTER (WHERE task = 'AR') AS answer_relevance_calls
       FROM (SELECT role, task, CASE WHEN answer IS NULL THEN NULL
               WHEN task = 'AR' THEN coalesce(TRY_CAST(nullif(regexp_extract(answer, '([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE), 0.5)
               WHEN contains(upper(answer), 'YES') THEN 1.0 ELSE 0.0 END AS v FROM {verdicts}) x GROUP BY role""",
)
def _(t: Tables):
    return V.rag_eval_rollup(t.verdicts)


@query("verdict_errors", "SELECT role, error, count(*) AS n FROM {verdicts} WHERE error IS NOT NULL GROUP BY role, error")
def _(t: Tables):
    return V.verdict_errors(t.verdicts)


view(
    "zero_inputs",
    """SELECT l_returnflag AS role, l_orderkey AS candidate_id, concat('REQ-', CAST(l_linenumber AS STRING)) AS req_name,
              concat('SQ', CAST(l_suppkey AS STRING)) AS sq_key, l_discount AS sub_score, l_tax > 0.02 AS evidence_found,
              l_quantity < 3 AS blocked FROM {lineitem}""",
)
view(
    "zero_o", spark="SELECT 1",
    oracle="""SELECT role, candidate_id, req_name, sq_key, CASE WHEN evidence_found THEN 'ZERO_WRONG_INFERENCE' ELSE 'ZERO_NO_EVIDENCE' END AS tag,
         rpad(CASE WHEN evidence_found THEN '[ZERO_WRONG_INFERENCE]' ELSE '[ZERO_NO_EVIDENCE]' END, 24, ' ') || ' ' || candidate_id || ' ' || req_name
           || ' ' || sq_key || ' — ' || CASE WHEN evidence_found THEN 'text found but LLM did not infer' ELSE 'no matching text found' END AS line
       FROM {zero_inputs} WHERE sub_score <= 0 AND NOT blocked""",
)


@query("zero_diagnostics", "SELECT * FROM {zero_o}")
def _(t: Tables):
    return V.zero_diagnostics(t.zero_inputs)


def diagnostics(t: Tables):
    return V.parse_diagnostics(V.zero_diagnostics(t.zero_inputs).select("role", "line"))


@query("run_report_profile", """SELECT role, count(*) AS n_candidates, min(total) AS min_total, max(total) AS max_total,
     round(avg(total), 4) AS mean_total, round(stddev_samp(total), 4) AS std, round(median(total), 6) AS median_total FROM {totals_o} GROUP BY role""")
def _(t: Tables):
    return V.report_profile(totals(t)).withColumn("median_total", F.round("median_total", 6))


@query(
    "run_report_diagnostics",
    """SELECT role, CAST(sum(a) AS BIGINT) AS n_no_evidence, CAST(sum(b) AS BIGINT) AS n_wrong_inference,
              arg_max(label, (n, label)) AS most_prone, max(n) AS most_prone_n
       FROM (SELECT role, req_name || ' (' || sq_key || ')' AS label, count(*) AS n, count(*) FILTER (WHERE tag = 'ZERO_NO_EVIDENCE') AS a,
                    count(*) FILTER (WHERE tag = 'ZERO_WRONG_INFERENCE') AS b FROM {zero_o} GROUP BY ALL) x GROUP BY role""",
)
def _(t: Tables):
    return V.report_diagnostics(diagnostics(t))


@query(
    "run_report_gaps",
    """SELECT a.role, a.req_name, sq_key, n, n_wrong_inference
       FROM (SELECT role, req_name, sq_key, count(*) AS n FROM {zero_o} GROUP BY ALL) a
       JOIN (SELECT role, req_name, count(*) FILTER (WHERE tag = 'ZERO_WRONG_INFERENCE') AS n_wrong_inference FROM {zero_o} GROUP BY ALL) b
         ON a.role = b.role AND a.req_name = b.req_name WHERE n_wrong_inference > 0
       ORDER BY n DESC, a.role, a.req_name, sq_key LIMIT 15""",
)
def _(t: Tables):
    return V.calibration_gaps(diagnostics(t))


# Candidates whose orders were returned unshipped are the audit's findings, some of them never scored.
view(
    "flagged_candidates",
    """SELECT l_returnflag AS role, CASE WHEN max(l_tax) > 0.07 THEN l_orderkey ELSE -l_orderkey END AS candidate_id,
              CASE WHEN min(l_discount) = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, max(l_quantity) / 50 AS quality
       FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY l_returnflag, l_orderkey""",
)


@query(
    "run_report_crossref",
    """SELECT f.*, r.rank, r.total, r.rank IS NOT NULL AS scored FROM {flagged_candidates} f
       LEFT JOIN {ranked_o} r ON f.role = r.role AND f.candidate_id = r.candidate_id""",
)
def _(t: Tables):
    return V.flagged_cross_reference(t.flagged_candidates, K.rank_candidates(totals(t)))


@query(
    "run_report_top10",
    """SELECT r.role, r.candidate_id, rank, total, arg_min(s.req_id, (contribution / weight_pct, s.req_id)) AS lowest_req,
              round(min(contribution / weight_pct), 6) AS lowest_share, max(severity) AS severity
       FROM {ranked_o} r JOIN {req_scores_o} s ON r.role = s.role AND r.candidate_id = s.candidate_id
       JOIN {line_weights} w ON w.role = s.role AND w.req_id = s.req_id
       LEFT JOIN {flagged_candidates} f ON f.role = r.role AND f.candidate_id = r.candidate_id
       WHERE rank <= 10 GROUP BY r.role, r.candidate_id, rank, total""",
)
def _(t: Tables):
    return V.top_ten(K.rank_candidates(totals(t), top_k=10), t.flagged_candidates, req_scores(t))
