import pytest
from pyspark.sql import functions as F

from rankwell.operators import audit as A, evaluation as V, identity as I, matching as M, scoring as S
from rankwell.sources import readers as R

TIERS = [
    ("tier_1", 1.0, 1, "mit", None), ("tier_2", 0.75, 1, "amity", None), ("tier_3", 0.5, 1, "osmania", "unverified"),
    ("tier_1", 1.0, 2, "_default_", None),
]


@pytest.fixture(scope="module")
def tiers(spark):
    return spark.createDataFrame(TIERS, "tier string, points double, entry_pos int, alias string, note string")


def test_tier_lookup(spark, tiers):
    names = ["Amity University", "MIT", "the _default_ place", "nowhere", "", "Osmania"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.tier, r.points) for r in M.tier_lookup(df, tiers).collect()}
    assert got["Amity University"] == ("tier_2", 0.75) and got["MIT"] == ("tier_1", 1.0)
    assert got["nowhere"] == got["the _default_ place"] == (None, 0.01) and got[""] == (None, 0.0)
    assert [r.name for r in M.flagged_names(df, tiers).collect()] == ["Osmania"]


SECTIONS = ["Experience", "experience", "Skills", "Projects", "Education", "Certifications", "Languages", "Personal_Info"]


def chunks(spark, size, skilled):
    rows = [("r", "c", f"c{i + 1}", i, s, "x" * size, ["Python"] if i in skilled else []) for i, s in enumerate(SECTIONS)]
    return spark.createDataFrame(rows, "role string, candidate_id string, chunk_id string, pos int, section string, text string, skills_asserted array<string>")


@pytest.mark.parametrize(
    ("name", "category", "size", "skilled", "want"),
    [
        ("python", "Core Skills", 10, {0}, ["c1", "c2", "c3", "c4"]),
        ("python", "Core Skills", 2000, {0, 3}, ["c1", "c4"]),
        ("python", "Core Skills", 2000, set(), ["c1", "c2", "c3", "c4"]),
        ("python", "Core Skills", 2000, {0, 1, 2, 3}, ["c1", "c2", "c3", "c4"]),
        ("BTech", "Education", 10, set(), ["c5"]),
    ],
)
def test_section_evidence(spark, name, category, size, skilled, want):
    reqs = spark.createDataFrame([("r", "q", name, category)], "role string, req_id string, req_name string, category string")
    got = M.section_evidence(chunks(spark, size, skilled), reqs).orderBy("pos").collect()
    assert [r.chunk_id for r in got] == want
    evidence = M.section_evidence(chunks(spark, size, skilled), reqs)
    for part_chars in (1 << 20, size + 9, 3):
        parts = M.evidence_text(evidence, part_chars).orderBy("part_no").collect()
        assert [p.part_no for p in parts] == list(range(len(parts))) and sum(p.n_chunks for p in parts) == len(want)
        assert "".join(p.text for p in parts) == M.SEPARATOR.join(["x" * size] * len(want))
    assert len(parts) == len(want)


def test_presence_uses_section_order_and_synonyms(spark):
    lines = [("r", "c", 1, "skills", 0, "MySQL, Excel"), ("r", "c", 0, "experience", 0, "used Postgres  daily"), ("r", "d", 1, "skills", 0, "nosql only")]
    lines = spark.createDataFrame(lines, "role string, candidate_id string, section_prio int, section string, pos int, text string")
    reqs = spark.createDataFrame([("r", 1, "SQL"), ("r", 2, "BE/BTech or equivalent")], "role string, req_id int, req_name string")
    got = M.presence_match(lines, reqs).collect()
    assert [(r.candidate_id, r.req_id, r.section, r.snippet) for r in got] == [("c", 1, "experience", "used Postgres daily")]
    degrees = spark.createDataFrame([("r", "e", 2, "education", 0, "B. Tech, 2010")], lines.schema)
    assert M.presence_match(degrees, reqs).first().req_id == 2


def test_scorer_vs_judge(spark):
    df = spark.createDataFrame([("r", "a", 70.0, 60.0), ("r", "b", 50.0, 55.0), ("r", "c", 40.0, 40.0)], "role string, candidate_id string, scorer_total double, judge_total double")
    row = V.scorer_vs_judge(df).filter("role = 'r'").first()
    assert (row.mae, row.rmse, row.bias, row.max_dev, row.r2) == (5.0, 6.455, 1.6667, 10.0, 0.4231)
    assert V.review_flags(df).count() == 0
    assert V.scorer_vs_judge(df.limit(1)).first().r2 == 1.0


def test_judge_responses(spark):
    good = '{"sub_scores": [{"key": "SQ001", "sub_score": 1}, {"key": "SQ003", "level": "some"}, {"key": "zzz", "sub_score": 1}]}'
    responses = [("r", c, "REQ-001", text) for c, text in (("a", good), ("b", '{"sub_scores": [{"key"'), ("c", "{}"))]
    responses = spark.createDataFrame(responses, "role string, candidate_id string, req_id string, response string")
    sub_queries = [("r", "REQ-001", "SQ001", "shown?", "binary", 3.0), ("r", "REQ-001", "SQ003", "depth?", "four_band", 3.0), ("r", "REQ-001", "SQ004", "How many years of it?", "four_band", 3.0)]
    sub_queries = spark.createDataFrame(sub_queries, "role string, req_id string, sq_key string, sq_text string, kind string, target_years double")
    got = {(r.candidate_id, r.sq_key): r.sub_score for r in S.score_judge_responses(responses, sub_queries).collect()}
    assert [got["a", k] for k in ("SQ001", "SQ003", "SQ004")] == [1.0, 0.5, 0.25]
    assert {got[c, k] for c in "bc" for k in ("SQ001", "SQ003", "SQ004")} == {0.01}
    tenure = spark.createDataFrame([("r", "b", 24)], "role string, candidate_id string, total_months int")
    got = {(r.candidate_id, r.sq_key): r.sub_score for r in S.score_judge_responses(responses, sub_queries, tenure).collect()}
    assert got["b", "SQ004"] == 0.5 and got["b", "SQ003"] == 0.01


def test_ids(spark):
    ids = ["BusinessAnalyst_CAND_0001", "SalesManager_CAND_0164", "bad", "_CAND_0001", "Role_CAND_1"]
    got = I.parse_ids(spark.createDataFrame([(i,) for i in ids], "candidate_id string")).collect()
    assert {(r.role, r.counter) for r in got} == {("BusinessAnalyst", 1), ("SalesManager", 164)}
    empty = spark.createDataFrame([], "source_path string, role string, candidate_id string, allocated_at timestamp, last_seen_at timestamp")
    paths = spark.createDataFrame([("/b", "A"), ("/a", "A"), ("/c", "B")], "source_path string, role string")
    first = I.allocate_ids(empty, paths, "2024-01-01 00:00:00")
    assert {(r.source_path, r.candidate_id) for r in first.collect()} == {("/a", "A_CAND_0001"), ("/b", "A_CAND_0002"), ("/c", "B_CAND_0001")}
    again = I.allocate_ids(first, paths, "2024-02-01 00:00:00")
    assert {(r.source_path, r.candidate_id) for r in again.collect()} == {(r.source_path, r.candidate_id) for r in first.collect()}
    with pytest.raises(Exception, match="invalid role"):
        I.allocate_ids(empty, paths.withColumn("role", F.lit("no good")), "2024-01-01 00:00:00").collect()


@pytest.mark.parametrize(("score", "critical", "want"), [(0.64, False, "failed"), (0.84, False, "review_required"), (0.9, True, "review_required"), (0.9, False, "passed")])
def test_status(spark, score, critical, want):
    row = spark.createDataFrame([(score,) * 6 + (critical,)], ", ".join(f"{c} double" for c in A.DIMENSION_WEIGHTS) + ", has_critical boolean")
    assert A.score_status(row).first().status == want


def test_unmapped_key_section_costs_half(spark):
    chunks_ = spark.createDataFrame([("c", "1", "skills", "x"), ("c", "2", "other", "y")], "candidate_id string, chunk_id string, section string, text string")
    mapped = spark.createDataFrame([("c", "f", "2"), ("c", "f", "9")], "candidate_id string, field string, chunk_id string")
    assert A.audit_evidence(chunks_.select("candidate_id").distinct(), mapped, chunks_).first().score == pytest.approx(1 - 1.5 / 3)


def test_profile_tree(spark, tmp_path):
    for name, text in {"A/a.json": '{"candidate_id": 1, "skills": ["x"]}', "A/a_structured_profile.json": "{}", "B/b.json": '{"candidate_id": 2, "sk'}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    from rankwell.plans.sources import PROFILE

    files = R.read_profile_files(spark, str(tmp_path))
    rows = R.scan_profiles(files, PROFILE).collect()
    assert [(r.role, r.candidate_id, r.skills) for r in rows] == [("A", 1, ["x"])]
    assert [tuple(r) for r in R.scan_rejects(files, PROFILE).collect()] == [("B", 1)]
