"""Exact vector retrieval: candidates' chunks against the sub-queries of their role."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions.vectors import dot, l2_normalize
from rankwell.operators.ranking import rank_candidates, top_rows
from rankwell.runtime import durable, small_side

DEFAULT_TOP_K = 5
DEFAULT_MAX_CHUNKS = 20


def normalize_vectors(chunks: DataFrame, column: str = "embedding") -> DataFrame:
    return chunks.withColumn(column, l2_normalize(F.col(column)))


def cosine_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per chunk and sub-query of the same role, with their cosine.

    ``chunks``: role, candidate_id, chunk_id, embedding; ``queries``: role, req_id, sq_pos, query.
    The role equi-join keeps every candidate to its own role's queries. The queries are broadcast when
    measured small, so chunks are scored where they are read; otherwise a hot role is split at run time. Cosines are kept to 9 dp, so that exact copies tie.
    """
    left = chunks.select("role", "candidate_id", "chunk_id", l2_normalize(F.col("embedding")).alias("_c"))
    right = queries.select("role", "req_id", "sq_pos", l2_normalize(F.col("query")).alias("_q"))
    return left.join(small_side(right), "role").select(
        "role", "candidate_id", "chunk_id", "req_id", "sq_pos",
        F.round(dot(F.col("_c"), F.col("_q")), 9).alias("cosine"),
    )


def topk_chunks(scored: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Best ``k`` chunks per candidate and sub-query, with no similarity floor."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    return top_rows(
        scored, ["role", "candidate_id", "req_id", "sq_pos"], [F.col("cosine").desc(), F.col("chunk_id")], k
    )


def threshold_chunks(scored: DataFrame, threshold: float = 0.10, max_chunks: int = DEFAULT_MAX_CHUNKS) -> DataFrame:
    """Chunks at or above the threshold, best first, at most ``max_chunks``; ``cap_hit`` tells when more passed.

    One row beyond the cap is kept through the trim, so whether the cap was hit is known without
    counting the whole group.
    """
    if not -1.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must lie in [-1, 1], got {threshold}")
    if max_chunks < 1:
        raise ValueError(f"max_chunks must be at least 1, got {max_chunks}")
    group = ["role", "candidate_id", "req_id", "sq_pos"]
    trimmed = top_rows(
        scored.filter(F.col("cosine") >= threshold),
        group,
        [F.col("cosine").desc(), F.col("chunk_id")],
        max_chunks + 1,
    )
    return trimmed.withColumn("cap_hit", F.max("rank").over(Window.partitionBy(*group)) > max_chunks).filter(
        F.col("rank") <= max_chunks
    )


def union_dedup_topk(scored: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, cap: int | None = None) -> DataFrame:
    """Evidence of a requirement: top-k per sub-query, one row per chunk, best cosine kept, then capped.

    The first sub-query wins a tie. Without ``cap`` the limit is min(20, max(10, 3 x sub-queries)).
    """
    hits = topk_chunks(scored, k)
    best = (
        hits.groupBy("role", "candidate_id", "req_id", "chunk_id")
        .agg(F.max_by(F.struct("sq_pos", "cosine"), F.struct(F.col("cosine"), (-F.col("sq_pos")).alias("s"))).alias("b"))
        .select("role", "candidate_id", "req_id", "chunk_id", "b.sq_pos", "b.cosine")
    )
    order = [F.col("cosine").desc(), F.col("chunk_id")]
    if cap is not None:
        return top_rows(best, ["role", "candidate_id", "req_id"], order, cap)
    caps = queries.groupBy("role", "req_id").agg(
        F.least(F.lit(20), F.greatest(F.lit(10), 3 * F.count(F.lit(1)))).alias("_cap")
    )
    trimmed = top_rows(best, ["role", "candidate_id", "req_id"], order, 20)
    return trimmed.join(caps, ["role", "req_id"]).filter(F.col("rank") <= F.col("_cap")).drop("_cap")


def best_cosine_scores(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Model-free total per candidate from the best cosine per sub-query.

    Max cosine clamped to [0,1] per sub-query, mean per requirement, weighted mean over all requirements
    times 100. A requirement that was not asked at all adds nothing but keeps its weight in the divisor.
    ``weights``: role, req_id, weight.
    """
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("cosine")))
    per_req = (
        scored.groupBy("role", "candidate_id", "req_id", "sq_pos")
        .agg(clamped.alias("best"))
        .groupBy("role", "candidate_id", "req_id")
        .agg(F.avg("best").alias("req_score"))
    )
    divisor = weights.groupBy("role").agg(F.sum("weight").alias("_all"))
    return (
        per_req.join(small_side(weights.join(divisor, "role")), ["role", "req_id"])
        .groupBy("role", "candidate_id")
        .agg(F.sum(F.col("req_score") * F.col("weight")).alias("_s"), F.max("_all").alias("_all"))
        .select(
            "role", "candidate_id",
            F.when(F.col("_all") > 0, F.col("_s") / F.col("_all") * 100).otherwise(F.lit(0.0)).alias("total"),
        )
    )


def with_name_queries(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``queries`` and, for each requirement without any, its name's vector as the only query, at position 0.

    ``names``: role, req_id, query.
    """
    bare = names.join(queries.select("role", "req_id").distinct(), ["role", "req_id"], "left_anti")
    return queries.select("role", "req_id", "sq_pos", "query").unionByName(bare.select("role", "req_id", F.lit(0).cast("long").alias("sq_pos"), "query"))


MAX_QUERIES = 50_000  # sub-queries of all roles, up to which their vectors are sent to every task


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=rows.copy(), where=norms > 0)


def _role_best(candidates: pa.Array, vectors: np.ndarray, block: tuple) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The candidates met, and for each of them and each query of the block the best cosine, as flat arrays."""
    req_ids, sq_pos, units = block
    if vectors.shape[1] != units.shape[0]:
        raise ValueError(f"vector dimension mismatch: {vectors.shape[1]} vs {units.shape[0]}")
    coded = candidates.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
    best = np.maximum.reduceat((_unit_rows(vectors) @ units)[order], starts, axis=0)
    return coded.dictionary.take(pa.array(codes[order][starts])), np.arange(len(starts)), best


def best_cosines(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(role, candidate_id, req_id, sq_pos, cosine): best cosines of a candidate's chunks, in part.

    The same as the maxima of :func:`cosine_scores`, but each batch of chunks is multiplied at once with the queries of
    its role, and only the best of each candidate leaves the batch; a row per chunk and query never exists. A candidate
    whose chunks lie in several batches has several rows per query, of which the largest counts. Beyond MAX_QUERIES the
    queries stay in a table and are joined.
    """
    asked = durable(queries.select("role", "req_id", "sq_pos", F.col("query").cast("array<double>").alias("query")).where("role IS NOT NULL AND query IS NOT NULL"))
    if asked.count() > MAX_QUERIES:
        return cosine_scores(chunks, asked)
    table = asked.toArrow()
    blocks = {}
    for role in table["role"].unique():
        own = table.filter(pc.equal(table["role"], role)).combine_chunks()
        rows = np.array(own["query"].to_pylist(), np.float64)
        blocks[role.as_py()] = (own["req_id"].chunk(0), own["sq_pos"].chunk(0), np.ascontiguousarray(_unit_rows(rows).T))
    shipped = chunks.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for role in batch.column("role").unique():
                block = shipped.value.get(role.as_py())
                if block is None:
                    continue
                own = batch.filter(pc.equal(batch.column("role"), role))
                vectors = own.column("embedding")
                sizes = np.diff(vectors.offsets.to_numpy())
                if (sizes != sizes[0]).any():
                    raise ValueError(f"vector dimension mismatch: {sizes.min()} vs {sizes.max()}")
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                names, rows, best = _role_best(own.column("candidate_id"), flat.reshape(len(own), -1), block)
                n = best.shape[1]
                each, every = pa.array(np.repeat(rows, n)), pa.array(np.tile(np.arange(n), len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([role.as_py()] * (n * len(rows)), batch.schema.field("role").type), names.take(each), block[0].take(every), block[1].take(every), pa.array(best.ravel())],
                    ["role", "candidate_id", "req_id", "sq_pos", "cosine"])

    rows = chunks.select("role", "candidate_id", F.col("embedding").cast("array<double>").alias("embedding")).where("role IS NOT NULL AND embedding IS NOT NULL")
    kinds = {**dict(asked.dtypes), **dict(rows.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("role", "candidate_id", "req_id", "sq_pos")) + ", cosine double"
    return rows.mapInArrow(run, schema).withColumn("cosine", F.round("cosine", 9))


def cosine_baseline_rank(chunks: DataFrame, queries: DataFrame, weights: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Rank candidates of a role by :func:`best_cosine_scores`; totals are rounded to 6 dp before ranking.

    With ``names`` (role, req_id, query) a requirement without sub-queries is asked by the vector of its name.
    """
    asked = queries if names is None else with_name_queries(queries, names)
    totals = best_cosine_scores(best_cosines(chunks, asked), weights)
    return rank_candidates(totals.withColumn("total", F.round("total", 6)))


def retrieval_metrics(thresholded: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Chunks returned per candidate and sub-query: mean, 95th percentile, share of cap hits, per role.

    ``candidates``: role, candidate_id; ``queries``: role, req_id, sq_pos. Each candidate is asked every query of its
    role, and one that returns nothing counts as 0 chunks without a cap hit.
    """
    returned = thresholded.groupBy("role", "candidate_id", "req_id", "sq_pos").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("cap_hit").alias("cap_hit")
    )
    asked = candidates.select("role", "candidate_id").distinct().join(small_side(queries.select("role", "req_id", "sq_pos").distinct()), "role")
    per_query = asked.join(returned, ["role", "candidate_id", "req_id", "sq_pos"], "left").select(
        "role", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("cap_hit", F.lit(False)).alias("cap_hit")
    )
    return per_query.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg("n_chunks").alias("avg_chunks"),
        F.percentile("n_chunks", F.lit(0.95)).alias("p95_chunks"),
        F.avg(F.col("cap_hit").cast("double")).alias("cap_hit_rate"),
    )


def relevance_metrics(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """Recall, precision, MRR and NDCG per query against a relevance table.

    ``ranked``: query_id, chunk_id, rank; ``labels``: query_id, chunk_id, relevance (0/1). NDCG compares
    with the best order of the query's own relevant chunks within the number of rows returned.
    """
    relevant = labels.filter(F.col("relevance") > 0).select("query_id", "chunk_id").distinct()
    gain = F.when(F.col("_hit"), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    hits = (
        ranked.join(relevant.withColumn("_hit", F.lit(True)), ["query_id", "chunk_id"], "left")
        .withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n_returned"),
            F.count_if("_hit").alias("n_hits"),
            F.min(F.when(F.col("_hit"), F.col("rank"))).alias("_first"),
            F.sum(gain).alias("_dcg"),
        )
    )
    totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least("n_relevant", "n_returned")),
        F.lit(0.0),
        lambda s, i: s + 1.0 / F.log2(i + 1),
    )
    return hits.join(totals, "query_id").select(
        "query_id",
        (F.col("n_hits") / F.col("n_relevant")).alias("recall"),
        (F.col("n_hits") / F.col("n_returned")).alias("precision"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.col("_dcg") / ideal).alias("ndcg"),
    )
