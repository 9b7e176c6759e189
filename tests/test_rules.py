"""Rules with hand-worked results that the driver's tables don't reach."""

import json

from pyspark.sql import functions as F

from rankwell.operators import audit, chunking, matching, ranking, retrieval, scoring
from rankwell.sources import writers

KEYS = "role string, candidate_id int, req_id string"


def test_code_only_requirements_need_no_evidence(spark):
    weights = [("r", "edu", 40.0, "education"), ("r", "skill", 60.0, "skill"), ("r", "none", 5.0, None)]
    out = scoring.apply_block_rules(
        spark.createDataFrame([("r", 1)], "role string, candidate_id int"),
        spark.createDataFrame(weights, "role string, req_id string, weight_pct double, req_type string"),
        spark.createDataFrame([("r", q, "a") for q in ("edu", "skill", "none")], "role string, req_id string, sq_key string"),
        spark.createDataFrame([], KEYS),
        spark.createDataFrame([("r", 1, q, 1.0) for q in ("edu", "skill", "none")], KEYS + ", sub_score double"),
    ).collect()
    assert {r.req_id: (r.reason, r.contribution) for r in out} == {"edu": (None, 40.0), "skill": ("no_evidence", 0.0), "none": ("no_evidence", 0.0)}


def test_last_answer_of_a_repeated_key_counts(spark):
    response = json.dumps({"sub_scores": [{"key": "a", "sub_score": "0.2"}, {"key": "b", "sub_score": "0.4"}, {"key": "a", "sub_score": "0.9"}]})
    out = scoring.score_judge_responses(
        spark.createDataFrame([("r", 1, "q", response)], KEYS + ", response string"),
        spark.createDataFrame([("r", "q", k, "How?", "direct", 0.0) for k in "ab"], "role string, req_id string, sq_key string, sq_text string, kind string, target_years double"),
    )
    assert {r.sq_key: r.sub_score for r in out.collect()} == {"a": 0.9, "b": 0.4}


def test_certificate_without_provider_goes_by_its_name(spark):
    aliases = "tier string, points double, entry_pos int, alias string, note string"
    rows = spark.createDataFrame([("r", 1, "", 5.0), ("r", 2, "", 5.0)], "role string, candidate_id int, raw_text string, grade double")
    asked = spark.createDataFrame([("r", "q", "Any", 10.0, "a", "Tier?", "certificate_rank")], "role string, req_id string, req_name string, weight_pct double, sq_key string, sq_text string, kind string")
    certs = spark.createDataFrame([("r", 1, 0, "Gold Course", " "), ("r", 2, 0, "Gold Course", "Nobody")], "role string, candidate_id int, pos int, cert string, provider string")
    degrees = spark.createDataFrame([], "role string, candidate_id int, pos int, degree string, institution string")
    tiers = spark.createDataFrame([("tier_1", 1.0, 0, "gold course", None)], aliases)
    none = spark.createDataFrame([], aliases)
    out = matching.code_only_req_score(rows, asked, degrees, certs, none, tiers).collect()
    assert {r.candidate_id: r.sub_score_sum for r in out} == {1: 1.0, 2: 0.5}


def test_queries_that_return_nothing_count(spark):
    hits = spark.createDataFrame([("r", 1, "q", 0, True), ("r", 1, "q", 0, True)], KEYS + ", sq_pos int, cap_hit boolean")
    asked = spark.createDataFrame([("r", "q", 0), ("r", "q", 1)], "role string, req_id string, sq_pos int")
    candidates = spark.createDataFrame([("r", 1), ("r", 1)], "role string, candidate_id int")
    row = retrieval.retrieval_metrics(hits, candidates, asked).first()
    assert (row.n_queries, row.avg_chunks, row.cap_hit_rate) == (2, 1.0, 0.5)


def test_empty_corpus_is_reported_as_such(spark):
    row = chunking.chunk_report(spark.createDataFrame([], "role string, candidate_id int, section string")).first()
    assert (row.total_chunks, row.total_candidates, row.advice) == (0, 0, "corpus is empty")


def test_repeated_chunk_ids_are_checked_once(spark):
    chunks = spark.createDataFrame([(1, "c", "skills", "text"), (1, "c", "skills", "")], "candidate_id int, chunk_id string, section string, text string")
    links = spark.createDataFrame([(1, "name", "c")], "candidate_id int, field string, chunk_id string")
    row = audit.audit_evidence(chunks.select("candidate_id").distinct(), links, chunks).first()
    assert (row.n_checks, row.score) == (1, 1.0)


def test_row_numbers_spread_a_large_group_and_keep_ties_apart(spark):
    rows = [("big" if i % 10 else f"g{i % 30}", i % 7, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "role string, score int, id int").repartition(6)
    out = ranking.row_numbers(df, ["role"], [F.col("score").desc(), F.col("id")])
    expected, seen = [], {}
    for role, score, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        seen[role] = seen.get(role, 0) + 1
        expected.append((role, score, i, seen[role]))
    assert sorted(map(tuple, out.select("role", "score", "id", "rank").collect())) == sorted(expected)


def test_saving_a_role_keeps_the_others_and_half_written_versions_are_skipped(spark, tmp_path):
    schema = "role string, candidate_id int, req_id string, sub_score_sum double, n_sq int, contribution double"
    for role in ("a", "b", "a"):
        ranked = spark.createDataFrame([(role, 1, 1)], "role string, candidate_id int, rank int")
        writers.export_ranked(ranked, spark.createDataFrame([(role, 1, "q", 1.0, 1, 5.0)], schema), ranked, str(tmp_path / "out"))
    assert sorted(r.role for r in spark.read.json(str(tmp_path / "out/rankings")).collect()) == ["a", "b"]

    chunks = spark.createDataFrame([("a", 1, [1.0])], "role string, chunk_id int, embedding array<float>")
    for version in (1, 2, 10):
        writers.write_chunk_table(chunks.withColumn("v", F.lit(version)), str(tmp_path / "chunks"), version)
    (tmp_path / "chunks/version=10/_SUCCESS").unlink()
    assert writers.read_chunk_table(spark, str(tmp_path / "chunks")).first().v == 2


def test_rows_lacking_evidence_are_those_the_block_rules_name(spark):
    reqs = spark.createDataFrame([("r", "a", 40.0, "skill"), ("r", "edu", 20.0, "education"), ("r", "unasked", 9.0, "skill"), ("r", "c", 5.0, None)], "role string, req_id string, weight_pct double, req_type string")
    asked = spark.createDataFrame([("r", q, k) for q in ("a", "edu", "c") for k in "xy"], "role string, req_id string, sq_key string")
    found = spark.createDataFrame([("r", 1, "a"), ("r", 1, "a"), ("r", 2, "c")], KEYS)
    people = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3)], "role string, candidate_id int")
    got = sorted(map(tuple, scoring.lacking_evidence(people, reqs, asked, found).collect()))
    rules = scoring.apply_block_rules(people, reqs, asked, found, spark.createDataFrame([], KEYS + ", sub_score double"))
    want = rules.where("reason = 'no_evidence'").select("role", "candidate_id", "req_id", "reason")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 4
