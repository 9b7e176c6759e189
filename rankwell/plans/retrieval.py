"""Registered queries: vector retrieval and the flagship ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import retrieval as R
from rankwell.plans.catalog import Tables, query, view

# Every stored vector is a chunk; ten consecutive chunks make a candidate, eight roles share the candidates.
view(
    "chunk_vectors",
    """SELECT vec_id AS chunk_id, CAST(floor(vec_id / 10) AS BIGINT) AS candidate_id,
              CAST(floor(vec_id / 10) % 8 AS INT) AS role, label, embedding
       FROM {embeddings}""",
)
# A role's sub-query per label is that label's earliest chunk in the role; three labels make a requirement.
view(
    "sub_queries",
    """SELECT role, CAST(floor(label / 3) AS INT) AS req_id, label AS sq_pos, min_by(embedding, chunk_id) AS query
       FROM {chunk_vectors} GROUP BY role, label""",
)
# Requirement 4 is weighted but has no sub-query: its name is the query. A name's vector is the latest chunk of its label.
view(
    "req_names",
    "SELECT role, label % 5 AS req_id, max_by(embedding, chunk_id) AS query FROM {chunk_vectors} GROUP BY role, label % 5",
)
view(
    "req_weights",
    """SELECT role, label % 5 AS req_id, CAST(count(*) AS DOUBLE) AS weight
       FROM {chunk_vectors} GROUP BY role, label % 5""",
)

_UNIT = "list_transform(CAST({c} AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST({c} AS DOUBLE[]), CAST({c} AS DOUBLE[]))))"
view(
    "scored",
    spark="SELECT 1",
    oracle="""SELECT c.role, candidate_id, chunk_id, req_id, sq_pos,
       round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(query AS DOUBLE[]))
         / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))
         / sqrt(list_dot_product(CAST(query AS DOUBLE[]), CAST(query AS DOUBLE[]))), 9) AS cosine
       FROM {chunk_vectors} c JOIN {sub_queries} q ON c.role = q.role""",
)
view(
    "scored_topk",
    spark="SELECT 1",
    oracle="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role, candidate_id, req_id, sq_pos
                 ORDER BY cosine DESC, chunk_id) AS rank FROM {scored}) t WHERE rank <= 5""",
)


def scored(t: Tables):
    return R.cosine_scores(t.chunk_vectors, t.sub_queries)


# A tiny negative number rounds to zero, never to minus zero.
@query(
    "l2_normalize",
    f"SELECT chunk_id, list_transform({_UNIT.format(c='embedding')}, lambda x: round(x, 6) + 0.0) AS unit "
    "FROM {chunk_vectors}",
)
def _(t: Tables):
    unit = R.normalize_vectors(t.chunk_vectors)
    return unit.select("chunk_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("unit"))


@query("cosine_scores", "SELECT role, candidate_id, chunk_id, req_id, sq_pos, round(cosine, 6) AS cosine FROM {scored}")
def _(t: Tables):
    return scored(t).withColumn("cosine", F.round("cosine", 6))


@query(
    "topk_chunks",
    "SELECT role, candidate_id, req_id, sq_pos, chunk_id, rank, round(cosine, 6) AS cosine FROM {scored_topk}",
)
def _(t: Tables):
    return R.topk_chunks(scored(t)).withColumn("cosine", F.round("cosine", 6))


@query(
    "threshold_chunks",
    """SELECT role, candidate_id, req_id, sq_pos, chunk_id, rank, n > 3 AS cap_hit, round(cosine, 6) AS cosine
       FROM (SELECT *, row_number() OVER (PARTITION BY role, candidate_id, req_id, sq_pos
                                          ORDER BY cosine DESC, chunk_id) AS rank,
                    count(*) OVER (PARTITION BY role, candidate_id, req_id, sq_pos) AS n
             FROM {scored} WHERE cosine >= 0.1) t WHERE rank <= 3""",
)
def _(t: Tables):
    return R.threshold_chunks(scored(t), 0.10, max_chunks=3).withColumn("cosine", F.round("cosine", 6))


@query(
    "union_dedup_topk",
    """SELECT role, candidate_id, req_id, chunk_id, sq_pos, rank, round(cosine, 6) AS cosine FROM (
         SELECT b.*, row_number() OVER (PARTITION BY b.role, candidate_id, b.req_id ORDER BY cosine DESC, chunk_id) AS rank,
                least(20, greatest(10, 3 * n_sq)) AS cap
         FROM (SELECT * FROM (SELECT role, candidate_id, req_id, chunk_id, sq_pos, cosine,
                     row_number() OVER (PARTITION BY role, candidate_id, req_id, chunk_id
                                        ORDER BY cosine DESC, sq_pos) AS pick FROM {scored_topk}) WHERE pick = 1) b
         JOIN (SELECT role, req_id, count(*) AS n_sq FROM {sub_queries} GROUP BY ALL) s
           ON b.role = s.role AND b.req_id = s.req_id) u
       WHERE rank <= cap""",
)
def _(t: Tables):
    return R.union_dedup_topk(scored(t), t.sub_queries).withColumn("cosine", F.round("cosine", 6))


view(
    "scored_names",
    spark="SELECT 1",
    oracle="""SELECT c.role, candidate_id, n.req_id,
       round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(query AS DOUBLE[]))
         / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))
         / sqrt(list_dot_product(CAST(query AS DOUBLE[]), CAST(query AS DOUBLE[]))), 9) AS cosine
       FROM {chunk_vectors} c JOIN {req_names} n ON c.role = n.role
       WHERE NOT EXISTS (SELECT 1 FROM {sub_queries} q WHERE q.role = n.role AND q.req_id = n.req_id)""",
)
view(
    "cosine_totals",
    spark="SELECT 1",
    oracle="""SELECT p.role, p.candidate_id, round(sum(p.req_score * w.weight) / max(d.total_weight) * 100, 6) AS total
       FROM (SELECT role, candidate_id, req_id, avg(best) AS req_score FROM (
               SELECT role, candidate_id, req_id, sq_pos, greatest(0.0, least(1.0, max(cosine))) AS best
               FROM (SELECT role, candidate_id, req_id, sq_pos, cosine FROM {scored} UNION ALL SELECT role, candidate_id, req_id, 0, cosine FROM {scored_names}) GROUP BY ALL) GROUP BY ALL) p
       JOIN {req_weights} w ON p.role = w.role AND p.req_id = w.req_id
       JOIN (SELECT role, sum(weight) AS total_weight FROM {req_weights} GROUP BY role) d ON p.role = d.role
       GROUP BY p.role, p.candidate_id""",
)


def cosine_ranked(t: Tables):
    return R.cosine_baseline_rank(t.chunk_vectors, t.sub_queries, t.req_weights, t.req_names)


@query(
    "cosine_baseline_rank",
    """SELECT role, candidate_id, total,
              row_number() OVER (PARTITION BY role ORDER BY total DESC, candidate_id) AS rank FROM {cosine_totals}""",
)
def _(t: Tables):
    return cosine_ranked(t)


@query(
    "retrieval_metrics",
    """SELECT role, count(*) AS n_queries, avg(least(n, 3)) AS avg_chunks,
              quantile_cont(least(n, 3), 0.95) AS p95_chunks, avg(CAST(n > 3 AS INT)) AS cap_hit_rate
       FROM (SELECT role, candidate_id, req_id, sq_pos, count(*) FILTER (WHERE cosine >= 0.1) AS n FROM {scored} GROUP BY ALL) t GROUP BY role""",
)
def _(t: Tables):
    return R.retrieval_metrics(R.threshold_chunks(scored(t), 0.10, max_chunks=3), t.chunk_vectors, t.sub_queries)
