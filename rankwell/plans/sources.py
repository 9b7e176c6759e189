"""Registered queries: sources, sinks and the flag stream. Files go to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.operators import ranking as K
from rankwell.operators.retrieval import cosine_scores, topk_chunks
from rankwell.plans.catalog import Tables, query, view
from rankwell.plans.scoring import req_scores, totals
from rankwell.runtime import scratch_path
from rankwell.sources import readers as R, writers as W
from rankwell.streaming import flags as S

PROFILE = T.StructType([T.StructField("candidate_id", T.LongType()), T.StructField("skills", T.ArrayType(T.StringType()))])

# Part files of a tree stand for profile files: roles are folders; some rows are cut short.
view(
    "profile_json",
    """SELECT source AS role, doc_id, CASE WHEN n_chars % 10 = 3 THEN concat('{"candidate_id": ', CAST(doc_id AS STRING), ', "skills": ["a')
              ELSE concat('{"candidate_id": ', CAST(doc_id AS STRING), ', "skills": ["', lang, '", "x"]}') END AS value FROM {documents}""",
)


def _tree(t: Tables) -> str:
    """Writes the rows as one JSON document per file name, the way an extraction run leaves them."""
    root = scratch_path(t.spark, "profiles")
    rows = t.profile_json.withColumn("folder", F.col("role")).select("folder", "value")
    rows.write.partitionBy("folder").text(root)
    return root


@query(
    "scan_jsonl_lenient",
    "SELECT doc_id AS candidate_id, [lang, 'x'] AS skills FROM documents WHERE n_chars % 10 <> 3",
)
def _(t: Tables):
    return R.scan_jsonl(t.spark, _tree(t), PROFILE).select("candidate_id", "skills")


# Files found under a root: canonical profiles and artefacts derived from them.
view(
    "found_files",
    """SELECT concat('file:/data/', role, '/', CAST(p.doc_id AS STRING), CASE CAST(n_chars % 4 AS INT) WHEN 0 THEN '_structured_profile' WHEN 1 THEN '_intelligence_report' ELSE '' END, '.json') AS path, value
       FROM {profile_json} p JOIN {documents} d ON p.doc_id = d.doc_id""",
)


@query(
    "scan_profiles",
    """SELECT doc_id AS candidate_id, [lang, 'x'] AS skills, source AS role, 'file:/data/' || source || '/' || doc_id || '.json' AS source_file
       FROM documents WHERE n_chars % 4 > 1 AND n_chars % 10 <> 3""",
)
def _(t: Tables):
    return R.scan_profiles(t.found_files, PROFILE)


@query(
    "scan_rejects",
    "SELECT source AS role, count(*) AS n_rejected FROM documents WHERE n_chars % 4 > 1 AND n_chars % 10 = 3 GROUP BY source",
)
def _(t: Tables):
    return R.scan_rejects(t.found_files, PROFILE)


# A customer in one of two layouts: nested and flat, or at the root with entries.
view(
    "layout_json",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('{"candidate_id": "', CAST(c_custkey AS STRING), '", "candidate_profile": {"summary": "', c_name,
         '", "experience": [{"job_title": "', c_mktsegment, '", "company": " ", "start_date": "2019-01", "end_date": ', CASE WHEN c_nationkey > 9 THEN '"2020-02"' ELSE 'null' END,
         ', "is_current": true, "responsibilities": ["r1"], "tools_and_skills": ["t1", "t2"]}], "education": [{"degree": "BSc", "field_of_study": "", "major": "Law", "institution": "U"}], "skills": [{"name_canonical": "", "name_raw": "sql"}, {"name_canonical": "Go"}], "projects": ["p"]}}')
       ELSE concat('{"candidate_id": "', CAST(c_custkey AS STRING), '", "summary": {"value": "', c_name, '"}, "experience": {"entries": [{"title": "', c_mktsegment,
         '", "company": "ACME", "dates": "2018 - 2020", "location": "", "details": ["d1"]}]}, "education": {"entries": [{"description": "BSc | Law | U"}]}, "skills": ["sql", "Go"], "projects": ["p"]}') END AS raw_json FROM {customer}""",
)


@query(
    "normalize_layouts",
    """SELECT CAST(c_custkey AS VARCHAR) AS candidate_id, c_name AS summary, c_mktsegment AS title, CASE WHEN c_custkey % 2 = 1 THEN 'ACME' END AS company,
         CASE WHEN c_custkey % 2 = 1 THEN '2018 - 2020' WHEN c_nationkey > 9 THEN '2019-01 - 2020-02' ELSE '2019-01 - Present' END AS dates,
         CASE WHEN c_custkey % 2 = 1 THEN ['d1'] ELSE ['r1', 't1', 't2'] END AS details, 'BSc | Law | U' AS degree, ['sql', 'Go'] AS skills, ['p'] AS projects, []::VARCHAR[] AS languages FROM customer""",
)
def _(t: Tables):
    e = F.col("experience")[0]
    return R.normalize_layouts(t.layout_json).select(
        "candidate_id", "summary", e["title"].alias("title"), e["company"].alias("company"), e["dates"].alias("dates"),
        e["details"].alias("details"), F.col("education")[0]["description"].alias("degree"), "skills", "projects", "languages",
    )


@query("write_chunk_table", "SELECT role, candidate_id, chunk_id, embedding FROM {chunk_vectors}")
def _(t: Tables):
    base = scratch_path(t.spark, "chunks")
    chunks = t.chunk_vectors.select("role", "candidate_id", "chunk_id", "embedding")
    W.write_chunk_table(chunks.filter("label > 4"), base, version=1)
    W.write_chunk_table(chunks, base, version=2)
    return W.read_chunk_table(t.spark, base).select("role", "candidate_id", "chunk_id", "embedding")


@query(
    "bucketed_evidence",
    """SELECT role, candidate_id, req_id, sq_pos, chunk_id, rank, round(cosine, 6) AS cosine FROM {scored_topk}""",
)
def _(t: Tables):
    """The best chunks per sub-query out of a table bucketed by candidate, with no exchange of chunks."""
    path = scratch_path(t.spark, "bucketed")
    chunks = t.chunk_vectors.select("role", "candidate_id", "chunk_id", "embedding")
    stored = W.save_bucketed_chunks(chunks, path.rpartition("/")[2].replace("-", "_"), path, buckets=16)
    return topk_chunks(cosine_scores(stored, t.sub_queries)).withColumn("cosine", F.round("cosine", 6))


@query(
    "export_ranked",
    """SELECT r.role, r.candidate_id, r.rank, r.total, count(*) AS n_reqs, min(req_id) AS first_req, round(sum(contribution), 4) AS sum_contribution
       FROM {ranked_o} r JOIN {req_scores_o} s ON r.role = s.role AND r.candidate_id = s.candidate_id GROUP BY ALL""",
)
def _(t: Tables):
    base = scratch_path(t.spark, "ranked")
    scores, all_totals = req_scores(t), totals(t)
    summary = K.role_summary(all_totals.withColumn("n_evidence", F.lit(1)))
    W.export_ranked(K.rank_candidates(all_totals), scores, summary, base)
    reqs = "reqs array<struct<req_id:int,sub_score_sum:double,n_sq:long,contribution:double>>"
    back = t.spark.read.schema(f"candidate_id long, total double, rank long, {reqs}, role string").json(f"{base}/rankings")
    return back.select(
        "role", "candidate_id", "rank", "total", F.size("reqs").alias("n_reqs"), F.col("reqs")[0]["req_id"].alias("first_req"),
        F.round(F.aggregate("reqs", F.lit(0.0), lambda s, r: s + r["contribution"]), 4).alias("sum_contribution"),
    )


# An event is a flag; its properties are extra keys, one of which tries to replace a core key.
view(
    "event_flags",
    spark="""SELECT user_id AS candidate_id, concat('r', user_id % 3) AS role, event_id % 2 AS req_id, event_type AS flag_type, date_trunc('second', ts) AS timestamp, map('props', props, 'role', 'other') AS extra FROM {events}""",
    oracle="SELECT user_id AS candidate_id, 'r' || (user_id % 3) AS role, event_id % 2 AS req_id, event_type AS flag_type, date_trunc('second', ts) AS timestamp, props FROM events",
)


# The log below is written in no order of time, so any flag may come last.
ANY_ORDER = "36500 days"


def _log(t: Tables) -> str:
    path = scratch_path(t.spark, "flags")
    W.append_flags(t.event_flags.filter("value < 10"), path)
    W.append_flags(t.event_flags.filter("value >= 10 OR value IS NULL"), path)
    return path


@query("append_flags", "SELECT candidate_id, role, flag_type, timestamp, props, role AS core_role FROM {event_flags}")
def _(t: Tables):
    back = R.scan_jsonl(t.spark, _log(t), T.StructType.fromDDL(S.FLAG_SCHEMA))
    return back.select(
        "candidate_id", "role", "flag_type", "timestamp",
        F.try_element_at("fields", F.lit("props")).alias("props"), F.try_element_at("fields", F.lit("role")).alias("core_role"),
    )


@query(
    "flag_stream_counts",
    """SELECT date_trunc('day', timestamp) AS window_start, date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end, role, flag_type, count(*) AS n
       FROM {event_flags} GROUP BY ALL""",
)
def _(t: Tables):
    target, checkpoint = scratch_path(t.spark, "counts"), scratch_path(t.spark, "stream")
    S.run_flag_counts(t.spark, _log(t), target, checkpoint, late=ANY_ORDER, distinct=False)
    return S.read_flag_counts(t.spark, target)


@query(
    "flag_stream_distinct",
    """SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, role, flag_type, count(*) AS n
       FROM (SELECT DISTINCT date_trunc('day', timestamp) AS window_start, candidate_id, role, req_id, flag_type FROM {event_flags}) x GROUP BY ALL""",
)
def _(t: Tables):
    target, checkpoint = scratch_path(t.spark, "counts"), scratch_path(t.spark, "stream")
    S.run_flag_counts(t.spark, _log(t), target, checkpoint, late=ANY_ORDER)
    S.compact_flag_counts(t.spark, target)
    return S.read_flag_counts(t.spark, target)


# Each part has a requirement document of its own, with two requirements and a table.
view(
    "req_docs",
    """SELECT p_partkey AS doc, concat('# ', p_type, ': Sub-Query Set', nl, nl, 'intro', nl, '### REQ-001: ', p_name, ' ', nl, nl, '**Category:** ', CASE WHEN p_size < 10 THEN 'Preferred Skill' WHEN p_size < 20 THEN 'Experience' ELSE 'Core Skill' END, nl,
         '**Description:** Uses ', p_name, nl, '  daily.', nl, nl, '**Sub-Query Count:** 2', nl, '**Scoring Formula:** mean(x) | ', p_brand, nl, nl, '| # | Sub-Query | Type | Scale | Method |', nl, '|---|---|---|---|---|', nl,
         '| SQ001 | Is ', p_name, ' shown? | Binary | 0 or 1 | Look for: a', nl, '| SQ002 | How much? | Float | 0-1 | Formula: a|b | c |', nl, '| SQ003 | short | row |', nl, nl,
         '### REQ-002: Years of ', p_type, nl, 'First line', nl, '| SQ010 | How many years? | Float | years | Rubric |', nl, 'Second line', nl, CASE WHEN p_size > 25 THEN '**Note:** x' ELSE 'Third' END) AS text
       FROM (SELECT *, chr(10) AS nl FROM {part}) x""",
)


@query(
    "markdown_requirements",
    """SELECT p_partkey AS doc, 'REQ-001' AS req_id, p_name AS req_name, CASE WHEN p_size < 10 THEN 'Preferred Skill' WHEN p_size < 20 THEN 'Experience' ELSE 'Core Skill' END AS category,
              CASE WHEN p_size < 10 THEN 'preferred' ELSE 'required' END AS req_type, 'Uses ' || p_name || chr(10) || '  daily.' AS description, 2 AS subquery_count, 'mean(x) | ' || p_brand AS scoring_formula FROM part
       UNION ALL SELECT p_partkey, 'REQ-002', 'Years of ' || p_type, 'Unknown', 'required', 'First line Second line' || CASE WHEN p_size > 25 THEN '' ELSE ' Third' END, 1, '' FROM part""",
)
def _(t: Tables):
    return R.markdown_requirements(t.req_docs).drop("pos")


@query(
    "markdown_sub_queries",
    """SELECT p_partkey AS doc, 'REQ-001' AS req_id, 'SQ001' AS sq_key, 'Is ' || p_name || ' shown?' AS sq_text, 'Binary' AS sq_type, '0 or 1' AS scale, 'Look for: a' AS method FROM part
       UNION ALL SELECT p_partkey, 'REQ-001', 'SQ002', 'How much?', 'Float', '0-1', 'Formula: a|b|c' FROM part
       UNION ALL SELECT p_partkey, 'REQ-002', 'SQ010', 'How many years?', 'Float', 'years', 'Rubric' FROM part""",
)
def _(t: Tables):
    return R.markdown_sub_queries(t.req_docs).drop("pos", "line_no")
