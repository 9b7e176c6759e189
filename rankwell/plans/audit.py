"""Registered queries: data-quality audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import audit as A
from rankwell.plans.catalog import Tables, query, view

# A customer as a raw profile JSON; its key, balance, nation and segment decide what is wrong with it.
view(
    "raw_profiles",
    """SELECT c_custkey AS candidate_id, concat('{"schema_version": 1, "candidate_id": "c", "evidence_chunks": [], "field_evidence_map": {}, "raw": {}, ',
         CASE WHEN c_acctbal < 0 THEN '' ELSE '"validation": {}, ' END,
         CASE WHEN c_nationkey = 0 THEN '' WHEN c_nationkey = 1 THEN '"candidate_profile": "none", ' ELSE concat(
           '"candidate_profile": {"full_name": "x", "headline": ', CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' WHEN c_mktsegment = 'MACHINERY' THEN '7' ELSE '"h"' END,
           ', "summary": {"value": "s"}, "projects": [], "certifications": [], "languages": [], "phones": [], ',
           CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '"emails": [], ' END, '"links": ', CASE WHEN c_custkey % 5 = 0 THEN '[]' ELSE '{}' END,
           ', "skills": [{"name_raw": "SQL"}, ', CASE WHEN c_nationkey % 3 = 0 THEN '" "' ELSE '"R"' END, ', {"name_raw": "", "name_canonical": "Go"}]',
           ', "experience": [{"start_date": "2019-01", "end_date": null, "is_current": ', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END,
           '}, {"start_date": "', CASE WHEN c_custkey % 7 = 0 THEN 'Jan 2020' ELSE '2020' END, '", "end_date": "2021-05"}', CASE WHEN c_custkey % 11 = 0 THEN ', "junk"' ELSE '' END,
           '], "education": {"entries": [{"start_date": "2010", "end_date": ', CASE WHEN c_custkey % 3 = 1 THEN '"20xx"' ELSE '"2014-06"' END, '}]}}, ') END,
         '"confidence": {"document_confidence": ', CASE WHEN c_custkey % 13 = 0 THEN '"high"' WHEN c_acctbal > 9000 THEN '1.5' ELSE '0.5' END, '}}') AS raw_json FROM {customer}""",
)
view(
    "schema_o", spark="SELECT 1",
    oracle="""SELECT candidate_id, n_checks, n_failed, CASE WHEN ok THEN greatest(0, 1 - CAST(n_failed AS DOUBLE) / n_checks) ELSE 0 END AS score
       FROM (SELECT c_custkey AS candidate_id, c_nationkey > 1 AS ok,
          CASE WHEN c_nationkey > 1 THEN 8 + 12 + 6 + 2 + 3 + 1 ELSE 8 END AS n_checks,
          CAST(c_acctbal < 0 AS INT) + CAST(c_nationkey < 2 AS INT) + CASE WHEN c_nationkey < 2 THEN 0 ELSE CAST(c_mktsegment = 'MACHINERY' AS INT)
            + CAST(c_custkey % 4 = 0 AS INT) + CAST(c_custkey % 5 = 0 AS INT) + CAST(c_nationkey % 3 = 0 AS INT) + CAST(c_custkey % 2 = 1 AS INT)
            + CAST(c_custkey % 7 = 0 AS INT) + CAST(c_custkey % 11 = 0 AS INT) + CAST(c_custkey % 3 = 1 AS INT)
            + CAST(c_custkey % 13 = 0 OR c_acctbal > 9000 AS INT) END AS n_failed FROM customer) x""",
)


@query("audit_schema", "SELECT candidate_id, n_checks, n_failed, round(score, 6) AS score FROM {schema_o}")
def _(t: Tables):
    return A.audit_schema(t.raw_profiles).select(
        "candidate_id", "n_checks", F.size("checks").alias("n_failed"), F.round("score", 6).alias("score")
    )


# A document is the raw text of a profile; labelled documents had their fields extracted, the rest came out empty.
view(
    "text_profiles",
    """SELECT d.doc_id AS candidate_id, source AS role, concat(text, CASE WHEN n_chars % 3 = 0 THEN ' Work History: Jan 2018 - Dec 2019, 2015 - 2016 and 2001-Present' WHEN n_chars % 3 = 1
                THEN ' Education: b.sc at a college. linkedin.com/in/x' ELSE ' Technical skills: aws, call 555-123-4567' END) AS raw_text,
         coalesce(quality, 0) AS n_emails, coalesce(toxic, 0) AS n_phones, coalesce(quality, 0) AS n_links, coalesce(quality, 0) + coalesce(toxic, 0) AS n_experience,
         coalesce(1 - quality, 0) AS n_education, coalesce(toxic, 0) AS n_certifications, coalesce(quality, 0) AS n_skills
       FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
)
_B = r"(^|[^\p{L}\p{N}_])"
_E = r"([^\p{L}\p{N}_]|$)"
view(
    "complete_o", spark="SELECT 1",
    oracle=rf"""SELECT candidate_id, CAST(email AND n_emails = 0 AS INT) + CAST(phone AND n_phones = 0 AS INT) + CAST(link AND n_links = 0 AS INT) + CAST(cert AND n_certifications = 0 AS INT) AS n_field,
         CAST(job AND n_experience = 0 OR (NOT (job AND n_experience = 0) AND spans > 2 AND n_experience <= spans // 2) AS INT) + CAST(edu AND n_education = 0 AS INT) + CAST(skill AND n_skills = 0 AS INT) AS n_section,
         CAST(NOT (edu AND n_education = 0) AND eduword AND n_education = 0 AS INT) AS n_hint
       FROM (SELECT *, regexp_matches(c, '[\w\.-]+@[\w\.-]+\.\w+') AS email,
               regexp_matches(c, '(?:\+?[0-9]{{1,4}}[-.\s]?)?\(?[0-9]{{2,4}}\)?[-.\s]?[0-9]{{3,4}}[-.\s]?[0-9]{{3,4}}') AS phone,
               regexp_matches(c, '(linkedin|github)\.com/[a-zA-Z0-9_\-/]+') AS link,
               regexp_matches(c, '(?i){_B}(experience|employment|work history|career|history){_E}') AS job,
               regexp_matches(c, '(?i){_B}(education|academic|background|studies){_E}') AS edu,
               regexp_matches(c, '(?i){_B}(skills|technical skills|expertise|technologies|proficiencies){_E}') AS skill,
               len(list_distinct(regexp_extract_all(c, '\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{{4}}\b|\b[0-9]{{4}}\b\s*-\s*(?:\b[0-9]{{4}}\b|Present|present|Current|current)'))) AS spans,
               regexp_matches(lower(c), 'certified|certification|aws|azure|gcp|pmp|scrum|oracle|cisco|ccna') AS cert,
               regexp_matches(lower(c), 'bachelor|master|phd|b\.sc|m\.sc|b\.tech|m\.tech|degree|university|college|institute') AS eduword
             FROM (SELECT *, trim(regexp_replace(raw_text, '\s+', ' ', 'g')) AS c FROM {{text_profiles}}) a) b""".replace("{{text_profiles}}", "{text_profiles}"),
)


@query(
    "audit_completeness",
    """SELECT candidate_id, n_field + n_section + n_hint AS n_failed, round(1 - (n_field + n_section + n_hint) / 7.0, 6) AS score,
              round(greatest(0, 1 - n_section / 3.0), 6) AS section_score FROM {complete_o}""",
)
def _(t: Tables):
    return A.audit_completeness(t.text_profiles).select(
        "candidate_id", F.size("checks").alias("n_failed"), F.round("score", 6).alias("score"),
        F.round("section_score", 6).alias("section_score"),
    )


# Lines are evidence chunks; each labelled document maps a field to its first line, and to a line that may not exist.
view(
    "evidence_chunks",
    """SELECT doc_id AS candidate_id, concat('c', CAST(line_no AS STRING)) AS chunk_id,
              CASE CAST(length(line) % 4 AS INT) WHEN 0 THEN 'Key Skills' WHEN 1 THEN 'Projects' ELSE 'other' END AS section,
              CASE WHEN length(line) % 19 = 0 THEN '  ' WHEN length(line) % 5 = 0 THEN concat(line, ' Designed') ELSE line END AS text FROM {doc_lines}""",
)
view(
    "evidence_map",
    """SELECT doc_id AS candidate_id, 'skills' AS field, 'c0' AS chunk_id FROM {labels}
       UNION ALL SELECT doc_id, 'experience', CASE WHEN quality = 1 THEN 'c1' ELSE 'c2' END FROM {labels} UNION ALL SELECT doc_id, 'projects', 'c1' FROM {labels} WHERE toxic = 1""",
)
view(
    "evidence_checks_o", spark="SELECT 1",
    oracle="""SELECT m.candidate_id, m.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'evidence_missing_chunk_id' WHEN trim(text) = '' THEN 'evidence_empty_chunk_text' END AS check_id,
         CASE WHEN c.chunk_id IS NULL OR trim(text) = '' THEN 1.0 ELSE 0.0 END AS penalty
       FROM {evidence_map} m LEFT JOIN {evidence_chunks} c ON m.candidate_id = c.candidate_id AND m.chunk_id = c.chunk_id
       UNION ALL SELECT candidate_id, chunk_id, 'evidence_unmapped_chunk', 0.5 FROM {evidence_chunks} c
       WHERE NOT EXISTS (SELECT 1 FROM {evidence_map} m WHERE m.candidate_id = c.candidate_id AND m.chunk_id = c.chunk_id)
         AND (section <> 'other' OR (length(trim(text)) > 30 AND regexp_matches(lower(text),
              'certified|certification|aws|azure|gcp|pmp|scrum|bachelor|master|phd|degree|university|college|developed|managed|designed|engineered|implemented')))""",
)
view(
    "evidence_score_o", spark="SELECT 1",
    oracle="""SELECT d.doc_id AS candidate_id, coalesce(n, 0) AS n_checks, coalesce(greatest(0, 1 - e / n), 1.0) AS score FROM documents d
       LEFT JOIN (SELECT candidate_id, count(*) AS n, sum(penalty) AS e FROM {evidence_checks_o} GROUP BY candidate_id) x ON x.candidate_id = d.doc_id""",
)


@query("evidence_checks", "SELECT candidate_id, chunk_id, check_id, penalty FROM {evidence_checks_o}")
def _(t: Tables):
    return A.evidence_checks(t.evidence_map, t.evidence_chunks).drop("field")


@query("audit_evidence", "SELECT candidate_id, n_checks, round(score, 6) AS score FROM {evidence_score_o}")
def _(t: Tables):
    out = A.audit_evidence(t.documents.select(F.col("doc_id").alias("candidate_id")), t.evidence_map, t.evidence_chunks)
    return out.withColumn("score", F.round("score", 6))


# Two extractions of a customer: the second takes name, mail and counts from slightly different columns.
view(
    "extraction_a",
    """SELECT c_custkey AS candidate_id, CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END AS full_name, array(concat(' A', CAST(c_custkey AS STRING), '@x.org'), 'b@x.org') AS emails,
              c_nationkey AS n_experience, c_custkey % 3 AS n_education FROM {customer}""",
    oracle="""SELECT c_custkey AS candidate_id, CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END AS full_name, [' A' || c_custkey || '@x.org', 'b@x.org'] AS emails,
              c_nationkey AS n_experience, c_custkey % 3 AS n_education FROM customer""",
)
view(
    "extraction_b",
    """SELECT c_custkey AS candidate_id, concat('Customer#', lpad(CAST(c_custkey + c_nationkey AS STRING), 9, '0')) AS full_name,
              CASE WHEN c_acctbal > 5000 THEN array('b@x.org', concat('a', CAST(c_custkey AS STRING), '@X.org')) ELSE array('b@x.org') END AS emails,
              CAST(c_acctbal / 400 AS INT) AS n_experience, c_custkey % 5 AS n_education FROM {customer}""",
    oracle="""SELECT c_custkey AS candidate_id, 'Customer#' || lpad(CAST(c_custkey + c_nationkey AS VARCHAR), 9, '0') AS full_name,
              CASE WHEN c_acctbal > 5000 THEN ['b@x.org', 'a' || c_custkey || '@X.org'] ELSE ['b@x.org'] END AS emails,
              CAST(trunc(c_acctbal / 400) AS INT) AS n_experience, c_custkey % 5 AS n_education FROM customer""",
)


@query(
    "audit_agreement",
    """SELECT *, (CAST(name_agrees AS INT) + CAST(emails_agree AS INT) + CAST(experience_agrees AS INT) + CAST(education_agrees AS INT)) / 4.0 AS score FROM (
         SELECT a.candidate_id, CASE WHEN a.full_name <> '' AND b.full_name <> '' THEN levenshtein(a.full_name, b.full_name) <= 2 ELSE a.full_name = b.full_name END AS name_agrees,
                list_sort(list_transform(a.emails, lambda e: lower(trim(e)))) = list_sort(list_transform(b.emails, lambda e: lower(trim(e)))) AS emails_agree,
                abs(a.n_experience - b.n_experience) <= 1 AS experience_agrees, abs(a.n_education - b.n_education) <= 1 AS education_agrees
         FROM {extraction_a} a JOIN {extraction_b} b ON a.candidate_id = b.candidate_id) x""",
)
def _(t: Tables):
    return A.audit_agreement(t.extraction_a, t.extraction_b)


# The document's own dimension scores, with schema, agreement and reading quality derived from its size and labels.
view(
    "side_scores",
    """SELECT d.doc_id AS candidate_id, source AS role, CASE WHEN toxic = 1 THEN 0.25 ELSE 1.0 END AS schema_score, CASE WHEN n_chars % 4 = 0 THEN 0.5 ELSE 1.0 END AS agreement_score,
              CASE WHEN n_chars % 7 = 0 THEN 'scanned' END AS ocr_text, CASE WHEN n_chars % 2 = 0 THEN CAST(0.75 AS DOUBLE) END AS document_confidence, toxic = 1 AND quality = 1 AS critical
       FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
)
view(
    "status_o", spark="SELECT 1",
    oracle="""SELECT *, CASE WHEN overall < 0.65 THEN 'failed' WHEN has_critical OR overall < 0.85 THEN 'review_required' ELSE 'passed' END AS status FROM (
         SELECT s.candidate_id, role, coalesce(critical, false) AS has_critical,
                0.20 * schema_score + 0.25 * (1 - (n_field + n_section + n_hint) / 7.0) + 0.20 * greatest(0, 1 - n_section / 3.0) + 0.20 * e.score
                + 0.10 * agreement_score + 0.05 * CASE WHEN ocr_text IS NULL THEN 1.0 ELSE coalesce(document_confidence, 0.7) END AS overall
         FROM {side_scores} s JOIN {complete_o} c ON c.candidate_id = s.candidate_id JOIN {evidence_score_o} e ON e.candidate_id = s.candidate_id) x""",
)


def statuses(t: Tables):
    done = A.audit_completeness(t.text_profiles).select("candidate_id", F.col("score").alias("field_score"), "section_score")
    proof = A.audit_evidence(t.documents.select(F.col("doc_id").alias("candidate_id")), t.evidence_map, t.evidence_chunks)
    fields = F.create_map(F.lit("full_name"), F.lit(0.9), F.lit("skills"), F.lit(0.5))
    sides = t.side_scores.select(
        "candidate_id", "role", F.col("schema_score").cast("double").alias("schema_score"),
        F.col("agreement_score").cast("double").alias("agreement_score"),
        A.ocr_score(F.col("ocr_text"), F.col("document_confidence"), fields).alias("ocr_score"),
        F.coalesce("critical", F.lit(False)).alias("has_critical"),
    )
    scores = sides.join(done, "candidate_id").join(
        proof.select("candidate_id", F.col("score").alias("evidence_score")), "candidate_id"
    )
    return A.score_status(scores)


def evidence_findings(t: Tables):
    return A.evidence_checks(t.evidence_map, t.evidence_chunks).filter("check_id IS NOT NULL").select(
        "candidate_id", "check_id",
        F.when(F.col("check_id") == "evidence_unmapped_chunk", "warning").otherwise("error").alias("severity"),
        F.lit("evidence").alias("layer"), F.col("field"),
    )


def all_checks(t: Tables):
    return A.explode_checks(A.audit_completeness(t.text_profiles)).unionByName(evidence_findings(t))


@query("audit_score_status", "SELECT candidate_id, role, round(overall, 6) AS overall, status FROM {status_o}")
def _(t: Tables):
    return statuses(t).select("candidate_id", "role", F.round("overall", 6).alias("overall"), "status")


view(
    "triggers_o", spark="SELECT 1",
    oracle="""SELECT candidate_id, 'error' AS severity, 'evidence' AS layer FROM {evidence_checks_o} WHERE check_id IN ('evidence_missing_chunk_id', 'evidence_empty_chunk_text')
       UNION ALL SELECT candidate_id, 'any' AS severity, 'section' AS layer FROM (SELECT candidate_id, unnest(range(n_section)) FROM {complete_o}) x""",
)


@query("review_triggers", "SELECT candidate_id, layer, count(*) AS n FROM {triggers_o} GROUP BY candidate_id, layer")
def _(t: Tables):
    return A.review_triggers(all_checks(t)).groupBy("candidate_id", "layer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_rollup",
    """SELECT role, count(*) AS n, count(*) FILTER (WHERE status = 'passed') AS n_passed, count(*) FILTER (WHERE status = 'review_required') AS n_review_required,
              count(*) FILTER (WHERE status = 'failed') AS n_failed, round(100.0 * count(*) FILTER (WHERE status = 'passed') / count(*), 6) AS pct_passed,
              round(avg(overall), 6) AS mean_overall FROM {status_o} GROUP BY ROLLUP (role)""",
)
def _(t: Tables):
    out = A.audit_rollup(statuses(t))
    return out.withColumn("pct_passed", F.round("pct_passed", 6)).withColumn("mean_overall", F.round("mean_overall", 6))


@query("severity_counts", """SELECT candidate_id, 0 AS n_critical, count(*) FILTER (WHERE check_id <> 'evidence_unmapped_chunk') AS n_error,
     count(*) FILTER (WHERE check_id = 'evidence_unmapped_chunk') AS n_warning FROM {evidence_checks_o} WHERE check_id IS NOT NULL GROUP BY candidate_id""")
def _(t: Tables):
    return A.severity_counts(evidence_findings(t))


@query(
    "review_queue",
    """SELECT s.role, s.candidate_id, status, round(overall, 6) AS overall, count(check_id) AS n_issues FROM {status_o} s
       LEFT JOIN {evidence_checks_o} e ON e.candidate_id = s.candidate_id AND check_id IS NOT NULL
       WHERE status <> 'passed' GROUP BY ALL""",
)
def _(t: Tables):
    queue = A.review_queue(statuses(t), evidence_findings(t))
    return queue.groupBy("role", "candidate_id", "status", F.round("overall", 6).alias("overall")).agg(
        F.count("check_id").alias("n_issues")
    )


@query("below_quality", "SELECT DISTINCT candidate_id FROM {status_o} WHERE overall < 0.8")
def _(t: Tables):
    return A.below_quality(statuses(t), 0.8)


# A customer's extracted lists with confidences; nation and balance leave some of them empty.
view(
    "list_profiles",
    spark="""SELECT c_custkey AS candidate_id, c_nationkey <> 4 AS has_profile, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name END AS full_name,
       CASE WHEN c_acctbal < 1000 THEN array() ELSE array('a@x.org') END AS emails, CASE WHEN c_acctbal < 3000 THEN CAST(NULL AS ARRAY<STRING>) ELSE array('1') END AS phones,
       CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(NULL AS ARRAY<STRUCT<confidence: DOUBLE>>) ELSE array(named_struct('confidence', CAST(0.9 AS DOUBLE)), named_struct('confidence', CAST(0.5 AS DOUBLE))) END AS skills,
       CASE WHEN c_nationkey = 5 THEN CAST(array() AS ARRAY<STRUCT<confidence: DOUBLE>>) ELSE array(named_struct('confidence', c_acctbal / 9001)) END AS education,
       CASE WHEN c_nationkey >= 5 AND c_mktsegment = 'BUILDING' THEN CAST(array() AS ARRAY<STRUCT<confidence: DOUBLE>>) ELSE array(named_struct('confidence', CAST(0.75 AS DOUBLE))) END AS experience,
       CAST(array() AS ARRAY<STRUCT<confidence: DOUBLE>>) AS certifications FROM {customer}""",
    oracle="""SELECT c_custkey AS candidate_id, c_nationkey <> 4 AS has_profile, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name END AS full_name,
       c_acctbal >= 1000 AS emails, c_acctbal >= 3000 AS phones, CASE WHEN c_mktsegment = 'BUILDING' THEN []::DOUBLE[] ELSE [0.9, 0.5] END AS skills,
       CASE WHEN c_nationkey = 5 THEN []::DOUBLE[] ELSE [c_acctbal / 9001] END AS education,
       CASE WHEN c_nationkey >= 5 AND c_mktsegment = 'BUILDING' THEN []::DOUBLE[] ELSE [0.75] END AS experience FROM customer""",
)


@query(
    "validate_profile",
    """SELECT candidate_id, list_filter([CASE WHEN full_name IS NULL THEN 'candidate_profile.full_name' END, CASE WHEN NOT emails THEN 'candidate_profile.emails' END], lambda x: x IS NOT NULL) AS missing_fields,
         list_filter([CASE WHEN NOT phones THEN 'phones' END, CASE WHEN len(skills) = 0 THEN 'skills' END, CASE WHEN len(education) = 0 THEN 'education' END, CASE WHEN len(experience) = 0 THEN 'experience' END], lambda x: x IS NOT NULL) AS warnings,
         full_name IS NOT NULL AND emails AS is_valid, round(coalesce(list_avg(skills || education || experience), CASE WHEN full_name IS NULL THEN 0.5 ELSE 0.9 END), 6) AS confidence
       FROM {list_profiles}""",
)
def _(t: Tables):
    return A.validate_profiles(t.list_profiles).withColumn("confidence", F.round("confidence", 6))


@query(
    "find_gaps",
    """SELECT candidate_id, list_filter([CASE WHEN NOT has_profile OR len(skills) = 0 THEN 'skills' END, CASE WHEN NOT has_profile OR len(experience) = 0 THEN 'experience' END,
         CASE WHEN NOT has_profile OR len(education) = 0 THEN 'education' END, 'certifications'], lambda x: x IS NOT NULL) AS gaps FROM {list_profiles}""",
)
def _(t: Tables):
    return A.find_gaps(t.list_profiles)


# A second extraction of the same customers fills what the first left out.
view(
    "patchable",
    spark="""SELECT c_custkey AS candidate_id, CASE WHEN c_nationkey = 3 THEN ' N/A ' ELSE c_name END AS full_name, CASE WHEN c_acctbal < 0 THEN 'None' WHEN c_acctbal < 2000 THEN NULL ELSE 'h' END AS headline, 's' AS summary,
       CASE WHEN c_mktsegment = 'BUILDING' THEN array() ELSE array('sql') END AS skills, array(c_mktsegment) AS education, CAST(NULL AS ARRAY<STRING>) AS experience, array('p') AS projects, array('c') AS certifications,
       array('en') AS languages, CASE WHEN c_nationkey > 12 THEN map('github', 'g', 'linkedin', '') ELSE map('other', 'o') END AS links FROM {customer}""",
    oracle="SELECT 1 AS unused",
)
view(
    "patches",
    spark="""SELECT c_custkey AS candidate_id, concat('New ', c_name) AS full_name, CASE WHEN c_nationkey % 2 = 0 THEN 'null' ELSE 'new h' END AS headline, 'new s' AS summary, array('r', 'go') AS skills,
       array('new') AS education, array(CAST(c_nationkey AS STRING)) AS experience, array('x') AS projects, array('x') AS certifications, array('x') AS languages,
       map('linkedin', 'l', 'github', 'new g', 'other', 'new o') AS links FROM {customer} WHERE c_acctbal < 8000""",
    oracle="SELECT 1 AS unused",
)


@query(
    "gap_fill_merge",
    """SELECT candidate_id, CASE WHEN c_nationkey = 3 AND p THEN 'New ' || c_name WHEN c_nationkey = 3 THEN ' N/A ' ELSE c_name END AS full_name,
              CASE WHEN c_acctbal < 2000 AND c_nationkey % 2 = 1 THEN 'new h' WHEN c_acctbal < 0 THEN 'None' WHEN c_acctbal < 2000 THEN NULL ELSE 'h' END AS headline,
              CASE WHEN c_mktsegment = 'BUILDING' AND p THEN 'r,go' WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'sql' END AS skills,
              CASE WHEN p THEN CAST(c_nationkey AS VARCHAR) END AS experience,
              CASE WHEN c_nationkey > 12 THEN 'g' WHEN p THEN 'new g' END AS github, CASE WHEN p THEN 'l' WHEN c_nationkey > 12 THEN '' END AS linkedin,
              CASE WHEN c_nationkey <= 12 THEN 'o' WHEN p THEN 'new o' END AS other,
              list_filter([CASE WHEN c_nationkey = 3 AND p THEN 'full_name' END, CASE WHEN c_acctbal < 2000 AND c_nationkey % 2 = 1 THEN 'headline' END, CASE WHEN c_mktsegment = 'BUILDING' AND p THEN 'skills' END,
                CASE WHEN p THEN 'experience' END, CASE WHEN p THEN 'links.linkedin' END, CASE WHEN p AND c_nationkey <= 12 THEN 'links.github' END, CASE WHEN p AND c_nationkey > 12 THEN 'links.other' END], lambda x: x IS NOT NULL) AS changed
       FROM (SELECT *, c_custkey AS candidate_id, c_acctbal < 8000 AS p FROM customer) x""",
)
def _(t: Tables):
    out = A.gap_fill(t.patchable, t.patches)
    return out.select(
        "candidate_id", "full_name", "headline", F.array_join("skills", ",").alias("skills"),
        F.array_join("experience", ",").alias("experience"),
        *[F.try_element_at("links", F.lit(k)).alias(k) for k in ("github", "linkedin", "other")], "changed",
    )


