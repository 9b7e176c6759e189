"""Registered queries: rank stability across trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import ranking, stability as S
from rankwell.plans.catalog import Tables, query, view
from rankwell.plans.retrieval import cosine_ranked

# Four ways to score a customer from its orders stand for four trials; a customer's nation is its role.
view(
    "trial_totals",
    """SELECT 'orders' AS study, c_nationkey AS role, trial, c_custkey AS candidate_id,
              CASE trial WHEN 0 THEN round(s, 2) WHEN 1 THEN CAST(n AS DOUBLE) WHEN 2 THEN round(s / n, 2) ELSE m END AS total
       FROM (SELECT c_nationkey, c_custkey, sum(o_totalprice) AS s, count(*) AS n, max(o_totalprice) AS m
             FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey) x
       CROSS JOIN (SELECT 0 AS trial UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) y""",
    spark="""SELECT 'orders' AS study, c_nationkey AS role, trial, c_custkey AS candidate_id,
              CASE trial WHEN 0 THEN round(s, 2) WHEN 1 THEN CAST(n AS DOUBLE) WHEN 2 THEN round(s / n, 2) ELSE m END AS total
       FROM (SELECT c_nationkey, c_custkey, sum(o_totalprice) AS s, count(*) AS n, max(o_totalprice) AS m
             FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey)
       LATERAL VIEW explode(array(0, 1, 2, 3)) t AS trial""",
)
view("trial_rankings", spark="SELECT 1", oracle="""SELECT study, role, trial, candidate_id,
     row_number() OVER (PARTITION BY study, role, trial ORDER BY total DESC, candidate_id) AS rank FROM {trial_totals}""")
# The threshold moves with the trial, the chunk size stays, the overlap is set for later trials only.
view(
    "trial_params",
    """SELECT DISTINCT study, trial, 'theta' AS hp, 0.20 + 0.05 * CAST(trial AS DOUBLE) AS value FROM {trial_totals}
       UNION ALL SELECT DISTINCT study, trial, 'size' AS hp, CAST(1000 AS DOUBLE) AS value FROM {trial_totals}
       UNION ALL SELECT DISTINCT study, trial, 'overlap' AS hp, 100.0 * CAST(trial AS DOUBLE) AS value
                 FROM {trial_totals} WHERE trial > 1""",
)
view(
    "pair_ranks", spark="SELECT 1",
    oracle="""SELECT a.study, a.role, a.trial AS trial_a, b.trial AS trial_b, a.candidate_id, a.rank AS ra, b.rank AS rb
       FROM {trial_rankings} a JOIN {trial_rankings} b
         ON a.study = b.study AND a.role = b.role AND a.candidate_id = b.candidate_id AND a.trial < b.trial""",
)
view(
    "pair_all", spark="SELECT 1",
    oracle="""SELECT m.*, k.kendall_tau, top_10_inter / (2.0 * least(10, n) - top_10_inter) AS top_10_jaccard,
         1 - top_10_inter / CAST(least(10, n) AS DOUBLE) AS newcomer_rate_top_10, 1 - top_10_inter / CAST(least(10, n) AS DOUBLE) AS drop_rate_top_10,
         top_50_inter / (2.0 * least(50, n) - top_50_inter) AS top_50_jaccard
       FROM (SELECT study, role, trial_a, trial_b, count(*) AS n, CAST(max(abs(ra - rb)) AS DOUBLE) AS max_rank_shift,
                    avg(abs(ra - rb)) AS mean_abs_rank_shift, corr(ra, rb) AS spearman_rho,
                    count(*) FILTER (WHERE ra <= 10 AND rb <= 10) AS top_10_inter,
                    count(*) FILTER (WHERE ra <= 50 AND rb <= 50) AS top_50_inter
             FROM {pair_ranks} GROUP BY ALL) m
       JOIN (SELECT x.study, x.role, x.trial_a, x.trial_b, avg(sign(x.ra - y.ra) * sign(x.rb - y.rb)) AS kendall_tau
             FROM {pair_ranks} x JOIN {pair_ranks} y ON x.study = y.study AND x.role = y.role
               AND x.trial_a = y.trial_a AND x.trial_b = y.trial_b AND x.candidate_id < y.candidate_id
             GROUP BY ALL) k
         ON m.study = k.study AND m.role = k.role AND m.trial_a = k.trial_a AND m.trial_b = k.trial_b""",
)
_P = "study, role, trial_a, trial_b"


def rankings(t: Tables):
    ranked = ranking.row_numbers(
        t.trial_totals, ["study", "role", "trial"], [F.col("total").desc(), F.col("candidate_id")]
    )
    return ranked.drop("total")


def _r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("topk_jaccard", f"SELECT {_P}, round(top_10_jaccard, 6) AS jaccard FROM {{pair_all}}")
def _(t: Tables):
    return _r6(S.topk_jaccard(rankings(t), 10), "jaccard")


@query("rank_shift", f"SELECT {_P}, max_rank_shift AS max_shift, round(mean_abs_rank_shift, 6) AS mean_shift FROM {{pair_all}}")
def _(t: Tables):
    return _r6(S.rank_shift(rankings(t)), "mean_shift")


@query(
    "rank_correlation",
    f"SELECT {_P}, round(kendall_tau, 6) AS kendall_tau, round(spearman_rho, 6) AS spearman_rho FROM {{pair_all}}",
)
def _(t: Tables):
    return _r6(S.rank_correlation(rankings(t)), "kendall_tau", "spearman_rho")


@query(
    "newcomer_drop",
    f"SELECT {_P}, round(newcomer_rate_top_10, 6) AS newcomer_rate, round(drop_rate_top_10, 6) AS drop_rate FROM {{pair_all}}",
)
def _(t: Tables):
    return _r6(S.newcomer_drop(rankings(t), 10), "newcomer_rate", "drop_rate")


_AXES = """SELECT study, role, hp,
      round(CASE WHEN max(d) = min(d) OR max(y) = min(y) THEN 0 ELSE pow(corr(d, y), 2) END, 4) AS r2
    FROM (SELECT p.study, p.role, names.hp, p.y, abs(coalesce(a.value, 0) - coalesce(b.value, 0)) AS d
          FROM ({pairs}) p JOIN (SELECT DISTINCT study, hp FROM {trial_params}) names ON p.study = names.study
          LEFT JOIN {trial_params} a ON a.study = p.study AND a.hp = names.hp AND a.trial = p.trial_a
          LEFT JOIN {trial_params} b ON b.study = p.study AND b.hp = names.hp AND b.trial = p.trial_b) x
    GROUP BY study, role, hp"""
view("study_axes_o", spark="SELECT 1", oracle=_AXES.replace("{pairs}", f"SELECT {_P}, mean_abs_rank_shift AS y FROM {{pair_all}}"))


@query("study_stability_axes", "SELECT * FROM {study_axes_o}")
def _(t: Tables):
    return S.study_axes(rankings(t), t.trial_params)


def _flag(metric: str, op: str, limit: str) -> str:
    return f"CASE WHEN {metric} {op} {limit} THEN '{metric}=' || printf('%.4f', {metric}) || ' {op} {float(limit):.2f}' END"


_FLAGS = ", ".join(_flag(m, "<" if above else ">", str(limit)) for m, limit, above in S.SOFT_TARGETS)
_MEANS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in S.METRICS)


@query(
    "study_stability",
    f"""SELECT s.*, list_filter([{_FLAGS}], lambda f: f IS NOT NULL) AS flags, top_axis, top_axis_r2
        FROM (SELECT study, role, count(*) AS pair_count, round(max(max_rank_shift), 2) AS max_rank_shift, {_MEANS}
              FROM {{pair_all}} GROUP BY study, role) s
        JOIN (SELECT study, role, max(r2) AS top_axis_r2, arg_max(hp, (r2, hp)) AS top_axis
              FROM {{study_axes_o}} GROUP BY study, role) a ON s.study = a.study AND s.role = a.role""",
)
def _(t: Tables):
    return S.study_stability(rankings(t), t.trial_params)


_ROUNDED = ", ".join(f"round({m}, 4) AS {m}" for m in S.METRICS)


@query(
    "baseline_stability",
    f"""SELECT study, role, count(*) AS config_count, avg(top_10_jaccard) AS mean_top_10_jaccard,
          avg(top_50_jaccard) AS mean_top_50_jaccard, max(max_rank_shift) AS worst_max_rank_shift,
          avg(mean_abs_rank_shift) AS mean_abs_rank_shift, median(mean_abs_rank_shift) AS median_abs_rank_shift,
          quantile_cont(mean_abs_rank_shift, 0.95) AS p95_abs_rank_shift, avg(kendall_tau) AS kendall_tau,
          avg(spearman_rho) AS spearman_rho, avg(newcomer_rate_top_10) AS mean_newcomer_rate_top_10,
          avg(drop_rate_top_10) AS mean_drop_rate_top_10
        FROM (SELECT study, role, max_rank_shift, {_ROUNDED} FROM {{pair_all}} WHERE trial_a = 0) x
        GROUP BY study, role""",
)
def _(t: Tables):
    return S.baseline_stability(rankings(t), baseline=0)


view("baseline_axes_o", spark="SELECT 1", oracle=_AXES.replace("{pairs}", f"SELECT {_P}, round(mean_abs_rank_shift, 4) AS y FROM {{pair_all}} WHERE trial_a = 0"))


@query("baseline_stability_axes", "SELECT * FROM {baseline_axes_o}")
def _(t: Tables):
    return S.baseline_axes(rankings(t), t.trial_params, baseline=0)


# The production ranking orders a role's candidates by their mean label.
view(
    "label_totals",
    "SELECT role, candidate_id, CAST(sum(label) AS DOUBLE) / count(*) AS total FROM {chunk_vectors} GROUP BY role, candidate_id",
)


@query(
    "baseline_alignment",
    """WITH j AS (
         SELECT b.role, b.candidate_id, b.total, row_number() OVER (PARTITION BY b.role ORDER BY b.total DESC, b.candidate_id) AS ra,
                row_number() OVER (PARTITION BY b.role ORDER BY p.total DESC, p.candidate_id) AS rb
         FROM {cosine_totals} b JOIN {label_totals} p ON b.role = p.role AND b.candidate_id = p.candidate_id)
       SELECT a.role, n_common, kendall_tau, round(corr(ra, rb), 6) AS spearman_rho,
              round(count(*) FILTER (WHERE ra <= 10 AND rb <= 10)
                / CAST(count(*) FILTER (WHERE ra <= 10 OR rb <= 10) AS DOUBLE), 6) AS top10_jaccard,
              round(max(total) FILTER (WHERE ra <= 10) - min(total) FILTER (WHERE ra <= 10), 6) AS top10_span
       FROM j a JOIN (SELECT x.role, round(avg(sign(x.ra - y.ra) * sign(x.rb - y.rb)), 6) AS kendall_tau
                      FROM j x JOIN j y ON x.role = y.role AND x.candidate_id < y.candidate_id GROUP BY x.role) k ON a.role = k.role
       JOIN (SELECT role, count(*) AS n_common FROM j GROUP BY role) c ON a.role = c.role
       GROUP BY a.role, n_common, kendall_tau""",
)
def _(t: Tables):
    out = S.baseline_alignment(cosine_ranked(t), ranking.rank_candidates(t.label_totals))
    return _r6(out, "kendall_tau", "spearman_rho", "top10_jaccard", "top10_span")
