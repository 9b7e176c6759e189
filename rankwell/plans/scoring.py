"""Registered queries: classification, bands, contributions, totals, ranks and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.functions import bands as B
from rankwell.operators import composed as C, ranking as K, scoring as S
from rankwell.plans.catalog import Tables, query, view
from rankwell.runtime import scratch_path

# A line item is one sub-query score: return flag = role, order = candidate, line number = requirement.
view(
    "sq_scores",
    """SELECT l_returnflag AS role, l_orderkey AS candidate_id, l_linenumber AS req_id,
              round(least(CAST(1 AS DOUBLE), l_discount * 10), 4) AS sub_score FROM {lineitem}""",
)
view(
    "line_weights",
    """SELECT l_returnflag AS role, l_linenumber AS req_id,
              round(100 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 4) AS weight_pct
       FROM {lineitem} GROUP BY l_returnflag, l_linenumber""",
)
view("line_candidates", "SELECT DISTINCT l_returnflag AS role, l_orderkey AS candidate_id FROM {lineitem}")
# The seventh requirement is asked without sub-queries; small discounts leave no evidence, untaxed lines no score.
view(
    "line_sub_queries",
    "SELECT DISTINCT l_returnflag AS role, l_linenumber AS req_id, l_linestatus AS sq_key FROM {lineitem} WHERE l_linenumber <> 7",
)
view(
    "line_evidence",
    "SELECT l_returnflag AS role, l_orderkey AS candidate_id, l_linenumber AS req_id FROM {lineitem} WHERE l_discount > 0.03",
)
view(
    "line_judged",
    """SELECT l_returnflag AS role, l_orderkey AS candidate_id, l_linenumber AS req_id,
              round(least(CAST(1 AS DOUBLE), l_discount * 10), 4) AS sub_score FROM {lineitem} WHERE l_tax > 0.02""",
)
# Sub-query wording follows the part's type, size and brand.
view(
    "sub_query_texts",
    """SELECT p_partkey AS req_id, concat(CASE WHEN p_size > 45 THEN 'provider_tier_' ELSE 'SQ' END, CAST(p_partkey AS STRING)) AS sq_key,
       concat(CASE p_type WHEN 'ECONOMY' THEN 'What tier is the University that taught '
                          WHEN 'STANDARD' THEN 'How many years of work relative to the target with '
                          WHEN 'SMALL' THEN 'Which prestige has the certification or school for '
                          WHEN 'LARGE' THEN 'CGPA or marks in '
                          WHEN 'PROMO' THEN 'How many years, expected 3 years, with '
                          ELSE 'How deep is the practice with ' END, p_name) AS sq_text,
       CASE WHEN p_size < 8 THEN 'Binary' ELSE 'Float' END AS sq_type,
       CASE WHEN p_retailprice > 1000 THEN '0-1 by year' ELSE '0-1' END AS scale,
       CASE WHEN p_brand < 'Brand#2' THEN 'Formula: min(x / target, 1)' ELSE 'Rubric: anchors' END AS method
       FROM {part}""",
)


def _like(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_BOTH = "(lower(sq_text) || chr(10) || lower(sq_key))"


@query(
    "classify_subquery",
    f"""SELECT req_id, sq_key,
      CASE WHEN lower(sq_type) IN ('binary', 'boolean', 'bool') THEN 'binary'
           WHEN {_like('lower(sq_text)', B.GRADE_WORDS)} THEN 'cgpa'
           WHEN {_like('lower(sq_key)', ['institute_tier', 'institution_rank'])} THEN 'institution_rank'
           WHEN {_like('lower(sq_key)', ['provider_tier', 'certificate_rank', 'cert_tier'])} THEN 'certificate_rank'
           WHEN {_like(_BOTH, B.TIER_WORDS)} AND {_like(_BOTH, B.CERTIFICATE_WORDS)} THEN 'certificate_rank'
           WHEN {_like(_BOTH, B.TIER_WORDS)} AND {_like(_BOTH, B.INSTITUTE_WORDS)} THEN 'institution_rank'
           ELSE 'four_band' END AS kind,
      (contains(lower(sq_text), 'year') OR contains(lower(sq_text), 'relative') OR contains(lower(scale), 'year'))
      AND (contains(lower(sq_text), 'relative to expected')
           OR (contains(lower(sq_text), 'how many years') AND contains(lower(sq_text), 'expected'))
           OR (contains(lower(sq_text), 'years of') AND contains(lower(sq_text), 'relative to'))
           OR contains(lower(method), 'formula') OR contains(lower(method), 'min(')) AS is_years
      FROM {{sub_query_texts}}""",
)
def _(t: Tables):
    return S.classify_subqueries(t.sub_query_texts).select("req_id", "sq_key", "kind", "is_years")


view(
    "band_inputs",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'Substantial depth' WHEN 'N' THEN 'some' ELSE 'few hints' END AS level,
              CASE WHEN l_tax < 0.01 THEN NULL ELSE l_quantity / 5 END AS years, CAST(l_linenumber AS DOUBLE) AS target_years,
              CASE WHEN l_tax > 0.07 THEN NULL WHEN l_linestatus = 'F' THEN l_discount * 100 ELSE l_quantity * 2 END AS grade,
              CASE WHEN l_linenumber > 3 THEN 70.0 ELSE 7.0 END AS grade_target,
              CASE WHEN l_linenumber = 1 THEN 0.01 WHEN l_linenumber = 2 THEN 0.75 ELSE 1.0 END AS points,
              l_discount > 0.05 AS met
       FROM {lineitem}""",
)


@query(
    "band_scores",
    """SELECT binary_points, level_points, years_points, grade_points, tier_points, count(*) AS n FROM (
         SELECT CASE WHEN met THEN 1.0 ELSE 0.0 END AS binary_points,
           CASE WHEN level LIKE 'Sub%' THEN 1.0 WHEN level = 'some' THEN 0.5 ELSE 0.25 END AS level_points,
           CASE WHEN years IS NULL THEN 0.01 WHEN years >= target_years THEN 1.0 WHEN years >= target_years / 2 THEN 0.5
                WHEN years >= target_years / 4 THEN 0.25 ELSE 0.01 END AS years_points,
           CASE WHEN (CASE WHEN grade_target > 10 AND grade <= 10 THEN grade * 10
                           WHEN grade_target <= 10 AND grade > 10 THEN grade / 10 ELSE grade END) >= grade_target
                THEN 1.0 ELSE 0.5 END AS grade_points,
           CASE WHEN points > 0.01 THEN points ELSE 0.5 END AS tier_points
         FROM {band_inputs}) x GROUP BY ALL""",
)
def _(t: Tables):
    c = F.col
    return (
        t.band_inputs.select(
            B.binary_score(c("met")).alias("binary_points"),
            B.qualitative_band(c("level")).alias("level_points"),
            B.years_band(c("years"), c("target_years")).alias("years_points"),
            B.grade_band(c("grade"), c("grade_target").cast("double")).alias("grade_points"),
            B.tier_band(c("points").cast("double")).alias("tier_points"),
        )
        .groupBy("binary_points", "level_points", "years_points", "grade_points", "tier_points")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# An order is a judged answer: status = role, order = candidate, priority = requirement.
view(
    "judge_raw",
    """SELECT o_orderstatus AS role, o_orderkey AS candidate_id, o_orderpriority AS req_id,
       CASE WHEN o_orderkey % 17 = 0 THEN '{"sub_scores": [{"key": "gate", "sub_'
       ELSE concat('{"sub_scores": [{"key": "gate", "sub_score": 0.', CAST(o_custkey % 10 AS STRING),
                   ', "evidence_found": "', CASE WHEN o_custkey % 5 = 0 THEN 'Yes' ELSE 'no' END,
                   '"}, {"key": "', CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'years' END,
                   '", "sub_score": 1, "extracted_years": "~', CAST(o_custkey % 6 AS STRING),
                   ' years", "level": "none"}, {"key": "depth", "level": "',
                   CASE o_custkey % 4 WHEN 0 THEN 'Substantial' WHEN 1 THEN 'some' WHEN 2 THEN 'few' ELSE 'none' END,
                   '"}, {"key": "fit", "sub_score": 1.7}]}') END AS response
       FROM {orders}""",
)
view(
    "judge_sub_queries",
    """SELECT DISTINCT o_orderstatus AS role, o_orderpriority AS req_id, 'gate' AS sq_key, 'Is it shown?' AS sq_text, 'binary' AS kind,
              CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS target_years FROM {orders}
       UNION ALL SELECT DISTINCT o_orderstatus, o_orderpriority, 'years', 'How many years of practice?', 'four_band',
              CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) FROM {orders}
       UNION ALL SELECT DISTINCT o_orderstatus, o_orderpriority, 'depth', 'How deep is it?', 'four_band',
              CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) FROM {orders}
       UNION ALL SELECT DISTINCT o_orderstatus, o_orderpriority, 'fit', 'How well does it fit?', 'other',
              CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) FROM {orders}""",
)
view(
    "judge_tenure",
    """SELECT o_orderstatus AS role, o_orderkey AS candidate_id, o_orderkey % 60 AS total_months
       FROM {orders} WHERE o_totalprice > 250000""",
)
_BAND = "CASE WHEN {y} >= target THEN 1.0 WHEN {y} >= target / 2 THEN 0.5 WHEN {y} >= target / 4 THEN 0.25 ELSE 0.01 END"


@query(
    "rubric_req_score",
    f"""WITH base AS (
          SELECT o_orderstatus AS role, o_orderkey AS candidate_id, o_orderpriority AS req_id, o_orderkey % 17 = 0 AS bad,
                 o_orderkey % 7 = 0 AS lost, o_custkey % 10 >= 5 OR o_custkey % 5 = 0 AS gate, o_custkey % 6 AS yrs,
                 CASE o_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.01 END AS depth,
                 CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS target,
                 CASE WHEN o_totalprice > 250000 THEN o_orderkey % 60 ELSE 0 END AS months FROM orders),
        s AS (
          SELECT *, CASE WHEN bad THEN 0.01 WHEN gate THEN 1.0 ELSE 0.0 END AS g,
                 CASE WHEN months > 0 THEN {_BAND.format(y='round(months / 12.0, 2)')}
                      WHEN bad OR lost THEN 0.01 ELSE {_BAND.format(y='yrs')} END AS y,
                 CASE WHEN bad THEN 0.01 ELSE depth END AS d FROM base)
        SELECT role, candidate_id, req_id, 'gate' AS sq_key, g AS sub_score FROM s
        UNION ALL SELECT role, candidate_id, req_id, 'years', CASE WHEN g >= 0.5 AND y <= 0.01 THEN 0.25 ELSE y END FROM s
        UNION ALL SELECT role, candidate_id, req_id, 'depth', CASE WHEN g >= 0.5 AND d <= 0.01 THEN 0.25 ELSE d END FROM s
        UNION ALL SELECT role, candidate_id, req_id, 'fit', CASE WHEN bad THEN 0.01 ELSE 1.0 END FROM s""",
)
def _(t: Tables):
    return S.score_judge_responses(t.judge_raw, t.judge_sub_queries, t.judge_tenure)


def _share(weight: str, total: str, n: str) -> str:
    """round(weight x total / n, 4) with halves away from zero, in whole numbers: weights and scores have four places."""
    return f"((2 * CAST(round(10000 * ({weight})) AS HUGEINT) * CAST(round(10000 * ({total})) AS HUGEINT) + 10000 * {n}) // (20000 * {n})) / 10000.0"


view(
    "blocked_o", spark="SELECT 1",
    oracle=f"""SELECT c.role, c.candidate_id, w.req_id,
         CASE WHEN n_sq IS NULL THEN 'no_sub_queries' WHEN n_ev IS NULL AND w.req_id <> 5 THEN 'no_evidence' WHEN n IS NULL THEN 'scoring_failed' END AS reason,
         CASE WHEN n_sq IS NULL OR (n_ev IS NULL AND w.req_id <> 5) THEN 0 WHEN n IS NULL THEN {_share('weight_pct', '0.01', '1')}
              ELSE {_share('weight_pct', 's', 'n')} END AS contribution
       FROM {{line_candidates}} c JOIN {{line_weights}} w ON c.role = w.role
       LEFT JOIN (SELECT role, req_id, count(*) AS n_sq FROM {{line_sub_queries}} GROUP BY ALL) q ON q.role = w.role AND q.req_id = w.req_id
       LEFT JOIN (SELECT role, candidate_id, req_id, count(*) AS n_ev FROM {{line_evidence}} GROUP BY ALL) e
         ON e.role = c.role AND e.candidate_id = c.candidate_id AND e.req_id = w.req_id
       LEFT JOIN (SELECT role, candidate_id, req_id, count(*) AS n, sum(sub_score) AS s FROM {{line_judged}} GROUP BY ALL) j
         ON j.role = c.role AND j.candidate_id = c.candidate_id AND j.req_id = w.req_id""",
)


def typed_weights(t: Tables):
    # the fifth requirement is one of education, which is scored without evidence
    return t.line_weights.withColumn("req_type", F.when(F.col("req_id") == 5, "education").otherwise("skill"))


def blocked(t: Tables):
    return S.apply_block_rules(t.line_candidates, typed_weights(t), t.line_sub_queries, t.line_evidence, t.line_judged)


@query(
    "block_rules",
    """SELECT role, candidate_id, round(sum(contribution), 4) AS total,
              count(*) FILTER (WHERE reason = 'no_sub_queries') AS n_no_sub_queries,
              count(*) FILTER (WHERE reason = 'no_evidence') AS n_no_evidence,
              count(*) FILTER (WHERE reason = 'scoring_failed') AS n_failed FROM {blocked_o} GROUP BY role, candidate_id""",
)
def _(t: Tables):
    return blocked(t).groupBy("role", "candidate_id").agg(
        F.round(F.sum("contribution"), 4).alias("total"),
        *[
            F.count_if(F.col("reason") == reason).alias(name)
            for reason, name in (
                ("no_sub_queries", "n_no_sub_queries"), ("no_evidence", "n_no_evidence"), ("scoring_failed", "n_failed")
            )
        ],
    )


@query(
    "no_evidence_flags",
    """SELECT b.role, candidate_id, b.req_id, 'no_evidence' AS flag_type, TIMESTAMP '2024-01-01 00:00:00' AS timestamp, 'Requirement ' || b.req_id AS requirement_name,
              array_to_string(k, '+') AS sub_query_keys, len(k) AS sub_query_count, CAST(0.35 AS DOUBLE) AS theta, 'Recursive' AS chunker
       FROM {blocked_o} b JOIN (SELECT role, req_id, list_sort(list(sq_key)) AS k FROM {line_sub_queries} GROUP BY ALL) q ON b.role = q.role AND b.req_id = q.req_id
       WHERE reason = 'no_evidence'""",
)
def _(t: Tables):
    reqs = t.line_weights.select("role", "req_id", F.concat(F.lit("Requirement "), F.col("req_id").cast("string")).alias("req_name"))
    lacking = S.lacking_evidence(t.line_candidates, typed_weights(t), t.line_sub_queries, t.line_evidence)
    flags = S.no_evidence_flags(lacking, reqs, t.line_sub_queries, "2024-01-01", 0.35)
    return flags.withColumn("sub_query_keys", F.array_join("sub_query_keys", "+"))


view(
    "req_scores_o", spark="SELECT 1",
    oracle=f"""SELECT s.role, candidate_id, s.req_id, sum(sub_score) AS sub_score_sum, count(*) AS n_sq,
                     {_share('max(weight_pct)', 'sum(sub_score)', 'count(*)')} AS contribution
       FROM {{sq_scores}} s JOIN {{line_weights}} w ON s.role = w.role AND s.req_id = w.req_id
       GROUP BY s.role, candidate_id, s.req_id""",
)
view(
    "totals_o", spark="SELECT 1",
    oracle="SELECT role, candidate_id, round(sum(contribution), 4) AS total FROM {req_scores_o} GROUP BY role, candidate_id",
)
view(
    "ranked_o", spark="SELECT 1",
    oracle="SELECT *, row_number() OVER (PARTITION BY role ORDER BY total DESC, candidate_id) AS rank FROM {totals_o}",
)


def req_scores(t: Tables):
    return S.req_scores(t.sq_scores, t.line_weights)


def totals(t: Tables):
    return S.composed_total(req_scores(t))


@query("composed_total", "SELECT * FROM {totals_o}")
def _(t: Tables):
    return totals(t)


@query("rank_candidates", "SELECT * FROM {ranked_o}")
def _(t: Tables):
    return K.rank_candidates(totals(t))


@query("rank_candidates_topk", "SELECT * FROM {ranked_o} WHERE rank <= 25")
def _(t: Tables):
    return K.rank_candidates(totals(t), top_k=25)


@query(
    "role_summary",
    """SELECT r.role, count(*) AS n_candidates, round(avg(total), 4) AS mean_total,
              count(*) FILTER (WHERE n_evidence IS NULL) AS zero_evidence,
              list(r.candidate_id ORDER BY rank) FILTER (WHERE rank <= 5) AS top_candidates
       FROM {ranked_o} r LEFT JOIN (SELECT role, candidate_id, count(*) AS n_evidence FROM {line_evidence} GROUP BY ALL) e
         ON r.role = e.role AND r.candidate_id = e.candidate_id GROUP BY r.role""",
)
def _(t: Tables):
    n = t.line_evidence.groupBy("role", "candidate_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    return K.role_summary(totals(t).join(n, ["role", "candidate_id"], "left").fillna(0, ["n_evidence"]))


@query(
    "pool_comparison",
    """SELECT r.*, pool_max, round(pool_mean, 6) AS pool_mean, pool_min, pool_size, round(pool_median, 6) AS pool_median
       FROM {ranked_o} r JOIN (SELECT role, max(total) AS pool_max, avg(total) AS pool_mean, min(total) AS pool_min,
             count(*) AS pool_size, median(total) AS pool_median FROM {ranked_o} GROUP BY role) p ON r.role = p.role""",
)
def _(t: Tables):
    return K.pool_comparison(K.rank_candidates(totals(t))).withColumn("pool_mean", F.round("pool_mean", 6)).withColumn("pool_median", F.round("pool_median", 6))


@query(
    "pool_requirements",
    """SELECT s.role, s.candidate_id, s.req_id, s.contribution, round(top10_mean, 6) AS top10_mean, round(rest_mean, 6) AS rest_mean
       FROM {req_scores_o} s JOIN (
         SELECT s.role, s.req_id, coalesce(avg(contribution) FILTER (WHERE rank <= 10), 0) AS top10_mean,
                coalesce(avg(contribution) FILTER (WHERE rank > 10), 0) AS rest_mean
         FROM {req_scores_o} s JOIN {ranked_o} r ON s.role = r.role AND s.candidate_id = r.candidate_id
         GROUP BY s.role, s.req_id) p ON s.role = p.role AND s.req_id = p.req_id""",
)
def _(t: Tables):
    return K.pool_requirements(K.rank_candidates(totals(t)), req_scores(t)).select(
        "role", "candidate_id", "req_id", "contribution",
        F.round("top10_mean", 6).alias("top10_mean"), F.round("rest_mean", 6).alias("rest_mean"),
    )


@query(
    "pool_cutoffs",
    """SELECT s.role, s.req_id, cutoff, round(sum(contribution) / max(least(cutoff, n)), 6) AS mean_contribution
       FROM {req_scores_o} s JOIN {ranked_o} r ON s.role = r.role AND s.candidate_id = r.candidate_id
       JOIN (SELECT unnest([10, 20, 50]) AS cutoff) c ON rank <= cutoff
       JOIN (SELECT role, count(*) AS n FROM {ranked_o} GROUP BY role) z ON z.role = s.role
       GROUP BY s.role, s.req_id, cutoff""",
)
def _(t: Tables):
    return K.pool_cutoffs(K.rank_candidates(totals(t)), req_scores(t)).withColumn("mean_contribution", F.round("mean_contribution", 6))


# A line item as a graded item of a legacy configuration.
view(
    "graded_inputs",
    """SELECT l_orderkey AS candidate_id, l_returnflag AS category, l_linenumber AS item, l_discount > 0.02 AS matched,
              CASE WHEN l_tax > 0.04 THEN 0.0 ELSE l_quantity / 10 END AS years, l_linenumber * CAST(2 AS DOUBLE) AS importance,
              l_linenumber * CAST(2.4 AS DOUBLE) AS normalized_importance, CAST(3 AS DOUBLE) AS expected_years FROM {lineitem}""",
)


@query(
    "graded_total",
    """SELECT candidate_id, category, round(sum(raw), 4) AS raw_score, sum(importance) AS max_score, round(sum(score), 4) AS score,
              CASE WHEN category IS NULL THEN round(round(sum(raw), 4) * 1.6, 2) END AS total
       FROM (SELECT *, round(raw * normalized_importance / importance, 2) AS score FROM (
               SELECT *, CASE WHEN NOT matched THEN 0 WHEN years <= 0 THEN round(importance * 0.3, 2)
                              ELSE round(importance * least(1, years / expected_years), 2) END AS raw FROM {graded_inputs}) a) b
       GROUP BY GROUPING SETS ((candidate_id, category), (candidate_id))""",
)
def _(t: Tables):
    items = t.graded_inputs.withColumn("years", F.col("years").cast("double"))
    return (
        S.graded_total(items, scale=1.6)
        .withColumn("raw_score", F.round("raw_score", 4))
        .withColumn("score", F.round("score", 4))
    )


# The same line items as requirements of a code-only configuration; lines 2 have no years target.
view(
    "code_only_inputs",
    """SELECT l_orderkey AS candidate_id, l_linenumber AS req_id,
              CASE WHEN l_linenumber <= 3 THEN 'Experience' WHEN l_linenumber <= 5 THEN 'Education' ELSE 'Core Skill' END AS category,
              CASE WHEN l_linenumber = 6 THEN 'Senior practice' ELSE 'Knowledge' END AS req_name, l_linenumber * CAST(3 AS DOUBLE) AS weight_pct,
              CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(7 AS DOUBLE) END AS expected_years, l_discount > 0.02 AS matched,
              CASE WHEN l_tax > 0.04 THEN CAST(0 AS DOUBLE) ELSE l_quantity / 10 END AS years FROM {lineitem}""",
)


@query(
    "code_only_v2",
    """SELECT candidate_id, round(sum(CASE WHEN blocked OR NOT matched THEN 0
                WHEN NOT is_years THEN weight_pct
                WHEN years > 0 THEN round(weight_pct * round(least(1, years / expected_years), 4), 4)
                ELSE round(weight_pct * 0.3, 4) END), 4) AS total, count(*) FILTER (WHERE blocked) AS n_blocked
       FROM (SELECT *, category = 'Experience' OR req_name = 'Senior practice' AS is_years,
                    (category = 'Experience' OR req_name = 'Senior practice') AND expected_years IS NULL AS blocked
             FROM {code_only_inputs}) x GROUP BY candidate_id""",
)
def _(t: Tables):
    return S.code_only_v2_total(t.code_only_inputs)


view(
    "unified_inputs",
    """SELECT l_orderkey AS candidate_id,
              CASE WHEN l_linenumber <= 2 THEN 'education' WHEN l_linenumber <= 4 THEN 'certification'
                   WHEN l_linenumber = 5 THEN 'location' ELSE 'skill' END AS dimension,
              l_linenumber * CAST(4 AS DOUBLE) AS importance, l_discount > 0.02 AS matched,
              CASE l_returnflag WHEN 'A' THEN CAST(1 AS DOUBLE) WHEN 'N' THEN CAST(0.75 AS DOUBLE) END AS tier_points,
              l_linestatus = 'F' AS flagged, l_tax * CAST(10 AS DOUBLE) AS judged FROM {lineitem}""",
)


@query(
    "unified_total",
    """SELECT candidate_id, round(sum(raw), 4) AS total_raw, sum(importance) AS total_max, round(round(sum(raw), 4) * 1.1, 2) AS total
       FROM (SELECT *, round(CASE dimension
               WHEN 'education' THEN CASE WHEN matched THEN coalesce(tier_points, 0.5) * importance * CASE WHEN flagged THEN 0.5 ELSE 1 END ELSE 0 END
               WHEN 'certification' THEN CASE WHEN matched THEN coalesce(tier_points, 0.5) * importance ELSE 0 END
               WHEN 'location' THEN CASE WHEN matched THEN importance ELSE 0 END
               ELSE judged * importance END, 2) AS raw FROM {unified_inputs}) x GROUP BY candidate_id""",
)
def _(t: Tables):
    return S.unified_total(t.unified_inputs, scale=1.1).withColumn("total_raw", F.round("total_raw", 4))


# Candidates and sub-queries of the vector views, with a place and a grade each, and a sixth requirement scored by code alone.
view(
    "pool_candidates",
    """SELECT DISTINCT role, candidate_id, concat('Works in ', CASE candidate_id % 3 WHEN 0 THEN 'Lyon' WHEN 1 THEN 'Berlin' ELSE 'Madrid' END) AS raw_text,
              CAST(candidate_id % 10 AS DOUBLE) AS grade FROM {chunk_vectors}""",
)
view(
    "pool_requirements",
    """SELECT role, req_id, 'Core Skill' AS category, concat(CAST(req_id + 2 AS STRING), '+ years of practice') AS req_name, weight AS weight_pct,
              CASE WHEN req_id = 1 THEN CAST(6 AS DOUBLE) END AS expected_years FROM {req_weights}
       UNION ALL SELECT DISTINCT role, 5, 'Location', 'Location: Lyon', CAST(10 AS DOUBLE), CAST(NULL AS DOUBLE) FROM {req_weights}""",
)
# Even roles state a number of years in the question.
view(
    "pool_questions",
    """SELECT role, req_id, sq_pos, concat('SQ', CAST(sq_pos AS STRING)) AS sq_key,
              CASE WHEN sq_pos % 3 = 0 THEN 'Is it shown?' WHEN sq_pos % 3 = 2 THEN 'How deep is it?'
                   WHEN role % 2 = 0 THEN 'How many years of practice, about 3 years?' ELSE 'How many years of practice?' END AS sq_text,
              CASE WHEN sq_pos % 3 = 0 THEN 'binary' ELSE 'four_band' END AS kind FROM {sub_queries}
       UNION ALL SELECT DISTINCT role, 5, 100, 'place', 'Does it fit?', 'binary' FROM {sub_queries}
       UNION ALL SELECT DISTINCT role, 5, 101, 'mark', 'CGPA of at least 6', 'cgpa' FROM {sub_queries}""",
)
# Every eleventh candidate has no chunks; the judge leaves every thirteenth unanswered.
view(
    "pool_responses",
    """SELECT role, candidate_id, req_id, concat('{"sub_scores": [{"key": "SQ', CAST(3 * req_id AS STRING), '", "sub_score": 0.', CAST(candidate_id % 10 AS STRING),
              '}, {"key": "SQ', CAST(3 * req_id + 1 AS STRING), '", "extracted_years": "', CAST(candidate_id % 7 AS STRING), ' years"}, {"key": "SQ', CAST(3 * req_id + 2 AS STRING), '", "level": "',
              CASE candidate_id % 4 WHEN 0 THEN 'Substantial' WHEN 1 THEN 'some' WHEN 2 THEN 'few' ELSE 'none' END, '"}]}') AS response
       FROM {pool_candidates} JOIN (SELECT 0 AS req_id UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) r ON candidate_id % 13 <> 0""",
)
view("pool_tenure", "SELECT role, candidate_id, candidate_id % 60 AS total_months FROM {pool_candidates} WHERE candidate_id % 2 = 0")
view(
    "pool_targets_o", spark="SELECT 1",
    oracle="""SELECT r.role, r.req_id, coalesce(expected_years, asked, CASE WHEN req_id <> 5 THEN CAST(req_id + 2 AS DOUBLE) END) AS target_years FROM {pool_requirements} r
       LEFT JOIN (SELECT role, req_id, CAST(3 AS DOUBLE) AS asked FROM {pool_questions} WHERE sq_text LIKE '%about 3 years%' GROUP BY ALL) q USING (role, req_id)""",
)


@query("target_years", "SELECT role, req_id, target_years FROM {pool_targets_o}")
def _(t: Tables):
    return C.target_years(t.pool_requirements, t.pool_questions)


view(
    "pool_scores_o", spark="SELECT 1",
    oracle=f"""SELECT role, candidate_id, req_id, weight_pct, reason, CASE WHEN reason IS NULL THEN {_share('weight_pct', 's', 'n')}
                   WHEN reason = 'scoring_failed' THEN {_share('weight_pct', '0.01', '1')} ELSE 0 END AS contribution
       FROM (
         SELECT role, candidate_id, req_id, max(weight_pct) AS weight_pct, sum(CASE WHEN gated AND kind = 'four_band' AND v <= 0.01 THEN 0.25 ELSE v END) AS s, count(kind) AS n,
                CASE WHEN count(kind) = 0 THEN 'no_sub_queries' WHEN req_id <> 5 AND candidate_id % 11 = 0 THEN 'no_evidence'
                     WHEN req_id <> 5 AND candidate_id % 13 = 0 THEN 'scoring_failed' END AS reason
         FROM (
           SELECT *, bool_or(kind = 'binary' AND v >= 0.5) OVER (PARTITION BY role, candidate_id, req_id) AND req_id <> 5 AS gated FROM (
             SELECT c.role, c.candidate_id, r.req_id, r.weight_pct, q.kind,
                    CASE WHEN q.sq_key = 'place' THEN CASE WHEN c.candidate_id % 3 = 0 THEN 1.0 ELSE 0.0 END
                         WHEN q.sq_key = 'mark' THEN CASE WHEN c.candidate_id % 10 >= 6 THEN 1.0 ELSE 0.5 END
                         WHEN q.kind = 'binary' THEN CASE WHEN c.candidate_id % 10 >= 5 THEN 1.0 ELSE 0.0 END
                         WHEN q.sq_pos % 3 = 2 THEN CASE c.candidate_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.01 END
                         ELSE {_BAND.format(y='y')} END AS v
             FROM {{pool_candidates}} c JOIN {{pool_requirements}} r ON c.role = r.role
             JOIN (SELECT role, req_id, target_years AS target FROM {{pool_targets_o}}) g ON g.role = r.role AND g.req_id = r.req_id
             LEFT JOIN {{pool_questions}} q ON q.role = r.role AND q.req_id = r.req_id,
             LATERAL (SELECT CASE WHEN c.candidate_id % 2 = 0 AND c.candidate_id % 60 > 0 THEN round((c.candidate_id % 60) / 12.0, 2) ELSE c.candidate_id % 7 END AS y) l) a) b
         GROUP BY role, candidate_id, req_id) x""",
)


def composed_inputs(t: Tables) -> C.Inputs:
    vectors = t.sub_queries.select("role", "req_id", "sq_pos", "query")
    no_tiers = "SELECT 'tier_1' AS tier, CAST(0 AS DOUBLE) AS points, 0 AS entry_pos, '' AS alias, '' AS note WHERE false"
    return C.Inputs(
        candidates=t.pool_candidates, requirements=t.pool_requirements,
        sub_queries=t.pool_questions.join(vectors, ["role", "req_id", "sq_pos"], "left"),
        chunks=t.chunk_vectors.where("candidate_id % 11 <> 0"), responses=t.pool_responses, tenure=t.pool_tenure,
        degrees=t.sql("SELECT role, candidate_id, 0 AS pos, '' AS degree, '' AS institution FROM {pool_candidates} WHERE false"),
        certs=t.sql("SELECT role, candidate_id, 0 AS pos, '' AS cert, '' AS provider FROM {pool_candidates} WHERE false"),
        institutes=t.sql(no_tiers), providers=t.sql(no_tiers),
    )


@query(
    "composed_pipeline",
    """SELECT *, row_number() OVER (PARTITION BY role ORDER BY total DESC, candidate_id) AS rank FROM (
         SELECT role, candidate_id, round(sum(contribution), 4) AS total, count(*) FILTER (WHERE reason IN ('no_sub_queries', 'no_evidence')) AS n_blocked,
                count(*) FILTER (WHERE reason = 'scoring_failed') AS n_failed FROM {pool_scores_o} GROUP BY role, candidate_id) x""",
)
def _(t: Tables):
    return C.composed_pipeline(t.spark, composed_inputs(t), scratch_path(t.spark, "composed"), "run", parts=2)
