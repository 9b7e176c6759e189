import pytest
from pyspark.sql import functions as F

from rankwell.operators import retrieval as R
from rankwell.sources.writers import save_bucketed_chunks


def axis(i, size=4, extra=0.0):
    return [1.0 if k == i else extra for k in range(size)]


@pytest.fixture(scope="module")
def scored(spark):
    chunks = [
        ("r", f"cand_00{c}", f"cand_00{c}__{i}", axis(i) if i < 2 else axis(3, extra=0.1)) for c in (1, 2) for i in range(3)
    ]
    chunks = spark.createDataFrame(chunks, "role string, candidate_id string, chunk_id string, embedding array<float>")
    queries = spark.createDataFrame(
        [("r", "REQ-1", 0, axis(0)), ("r", "REQ-1", 1, axis(1))], "role string, req_id string, sq_pos int, query array<float>"
    )
    return chunks, queries


def test_self_similarity_and_no_floor(scored):
    rows = R.topk_chunks(R.cosine_scores(*scored), 3).collect()
    assert len(rows) == 2 * 2 * 3
    assert all(r.cosine == 1.0 for r in rows if r.rank == 1)


def test_dimension_mismatch_fails(spark, scored):
    queries = scored[1].withColumn("query", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(Exception, match="dimension mismatch"):
        R.cosine_scores(scored[0], queries).collect()


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "embedding array<float>")
    assert sorted(r[0] for r in R.normalize_vectors(df).collect()) == [[0.0, 0.0], [0.6, 0.8]]


def test_threshold_cap_and_validation(scored):
    rows = R.threshold_chunks(R.cosine_scores(*scored), -1.0, max_chunks=2).collect()
    assert len(rows) == 8 and all(r.cap_hit for r in rows)
    rows = R.threshold_chunks(R.cosine_scores(*scored), -1.0, max_chunks=3).collect()
    assert len(rows) == 12 and not any(r.cap_hit for r in rows)
    with pytest.raises(ValueError):
        R.threshold_chunks(scored[0], 1.5)
    with pytest.raises(ValueError):
        R.threshold_chunks(scored[0], 0.5, max_chunks=0)


def test_union_keeps_one_row_per_chunk(scored):
    cosines = R.cosine_scores(*scored)
    rows = R.union_dedup_topk(cosines, scored[1], k=3).collect()
    assert len({(r.candidate_id, r.chunk_id) for r in rows}) == len(rows) == 6
    best = {r.chunk_id: r for r in rows if r.candidate_id == "cand_001"}
    assert best["cand_001__0"].sq_pos == 0 and best["cand_001__1"].sq_pos == 1
    assert best["cand_001__2"].sq_pos == 0  # a tie goes to the first sub-query
    assert R.union_dedup_topk(cosines, scored[1], k=3, cap=1).count() == 2


def test_top_k_grows_with_k(scored):
    cosines = R.cosine_scores(*scored)
    keys = [set(map(tuple, R.topk_chunks(cosines, k).drop("rank").collect())) for k in (1, 2, 3)]
    assert keys[0] < keys[1] < keys[2]


def test_relevance_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, chunk_id string, rank int")
    labels = spark.createDataFrame([("q", "b", 1), ("q", "z", 1)], "query_id string, chunk_id string, relevance int")
    row = R.relevance_metrics(ranked, labels).first()
    assert (row.recall, row.precision, row.reciprocal_rank) == (0.5, 0.5, 0.5)
    assert row.ndcg == pytest.approx(0.6309 / 1.6309, abs=1e-3)


def vectors(spark, n=300):
    import random

    r = random.Random(4)
    some = lambda: [r.uniform(-1, 1) for _ in range(6)]
    rows = [(k % 3 if k % 17 else None, k % 40, k, None if k == 50 else [0.0] * 6 if k == 9 else some()) for k in range(n)]
    chunks = spark.createDataFrame(rows, "role int, candidate_id int, chunk_id int, embedding array<float>")
    asked = [(role, req, pos, some()) for role in (0, 1) for req in (1, 2) for pos in range(req)] + [(1, 2, 9, [0.0] * 6)]
    return chunks, spark.createDataFrame(asked, "role int, req_id int, sq_pos int, query array<float>")


@pytest.mark.parametrize("limit", [50_000, 3])
def test_best_cosines_equal_the_maxima_of_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "MAX_QUERIES", limit)
    chunks, queries = vectors(spark)
    key = ["role", "candidate_id", "req_id", "sq_pos"]
    best = lambda df: {tuple(r)[:4]: r.best for r in df.groupBy(*key).agg(F.max("cosine").alias("best")).collect()}
    expected = best(R.cosine_scores(chunks.where("embedding IS NOT NULL"), queries))
    got = best(R.best_cosines(chunks.repartition(5), queries))
    assert len(expected) == 2 * 40 * 3 + 40 and got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) <= 1e-9 for k in got)
    assert R.best_cosines(chunks.limit(0), queries).count() == R.best_cosines(chunks, queries.limit(0)).count() == 0


def test_best_cosines_check_dimensions(spark, scored):
    queries = scored[1].withColumn("query", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(Exception, match="dimension mismatch"):
        R.best_cosines(scored[0], queries).collect()


def test_a_requirement_without_sub_queries_is_asked_by_its_name(spark, scored):
    chunks, queries = scored
    names = spark.createDataFrame([("r", "REQ-1", axis(3)), ("r", "REQ-2", axis(1))], "role string, req_id string, query array<float>")
    asked = {(r.req_id, r.sq_pos): r.query for r in R.with_name_queries(queries, names).collect()}
    assert asked == {("REQ-1", 0): axis(0), ("REQ-1", 1): axis(1), ("REQ-2", 0): axis(1)}
    weights = spark.createDataFrame([("r", "REQ-1", 3.0), ("r", "REQ-2", 1.0)], "role string, req_id string, weight double")
    lone = chunks.where("chunk_id LIKE '%__0'")  # equal to the first sub-query, orthogonal to all others
    assert {r.total for r in R.cosine_baseline_rank(lone, queries, weights, names).collect()} == {37.5}
    assert {r.total for r in R.cosine_baseline_rank(chunks, queries, weights, names).collect()} == {100.0}
    assert {r.total for r in R.cosine_baseline_rank(chunks, queries, weights).collect()} == {75.0}


def test_evidence_of_a_bucketed_table_needs_no_exchange_of_chunks(spark, scored, tmp_path):
    chunks, queries = scored
    table = save_bucketed_chunks(chunks.withColumn("text", F.lit("t")), "chunks_by_candidate", str(tmp_path / "chunks"), 4)
    try:
        flat, bucketed = R.cosine_scores(chunks, queries), R.cosine_scores(table, queries)
        for evidence in (lambda c: R.topk_chunks(c, 2), lambda c: R.threshold_chunks(c, -1.0, 2), lambda c: R.union_dedup_topk(c, queries, 3, 2)):
            plan = evidence(bucketed)._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan
            assert "Exchange hashpartitioning" in evidence(flat)._jdf.queryExecution().executedPlan().toString()
            assert "text" not in plan  # columns that decide nothing are not read
            assert sorted(map(str, evidence(bucketed).collect())) == sorted(map(str, evidence(flat).collect()))
        with pytest.raises(Exception, match="already exists"):
            save_bucketed_chunks(chunks, "chunks_by_candidate", str(tmp_path / "other"), 4)
    finally:
        spark.sql("DROP TABLE chunks_by_candidate")
    with pytest.raises(Exception, match="no vector for chunk"):
        save_bucketed_chunks(chunks.withColumn("embedding", F.lit(None).cast("array<float>")), "chunks_without", str(tmp_path / "none"), 4)
