"""Registered queries: matching requirements against profile text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.functions import matching as X
from rankwell.operators import matching as M
from rankwell.plans.catalog import Tables, query, view

# The words of part names rank the parts: longer words are better tiers, words on g carry a note.
view(
    "tier_alias",
    """SELECT CASE WHEN length(alias) >= 5 THEN 'tier_1' WHEN length(alias) = 4 THEN 'tier_2' ELSE 'tier_3' END AS tier,
              CASE WHEN length(alias) >= 5 THEN CAST(1 AS DOUBLE) WHEN length(alias) = 4 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS points,
              length(alias) AS entry_pos, alias, CASE WHEN alias LIKE 'g%' THEN 'not accredited' END AS note
       FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS alias FROM {part} UNION SELECT DISTINCT upper(split_part(p_name, ' ', 1)) FROM {part} WHERE p_name LIKE '%ring'
             UNION SELECT DISTINCT p_name FROM {part} WHERE p_name LIKE 'red %' UNION SELECT '_default_' FROM {region}) x
       WHERE alias <> 'rod'""",
)
view(
    "institute_names",
    """SELECT p_partkey AS id, CASE WHEN p_size = 1 THEN '' WHEN p_size = 2 THEN NULL WHEN p_size < 10 THEN concat('Pre', p_name, 's of ', p_type)
              ELSE concat('The ', upper(p_name), ', ', p_type) END AS name FROM {part}""",
)
view(
    "alias_hits_o", spark="SELECT 1",
    oracle=r"""SELECT id, name, a.* FROM {institute_names} n JOIN {tier_alias} a
       ON alias <> '_default_' AND regexp_matches(lower(trim(name)), '\b' || regexp_escape(lower(alias)) || '\b')""",
)


@query(
    "tier_lookup",
    """SELECT n.id, n.name, b.tier, CASE WHEN coalesce(trim(n.name), '') = '' THEN 0 ELSE coalesce(b.points, 0.01) END AS points
       FROM {institute_names} n LEFT JOIN (SELECT id, arg_min(tier, (tier, entry_pos)) AS tier, arg_min(points, (tier, entry_pos)) AS points
                                           FROM {alias_hits_o} GROUP BY id) b ON n.id = b.id""",
)
def _(t: Tables):
    return M.tier_lookup(t.institute_names, t.tier_alias)


@query("flagged_institutes", "SELECT DISTINCT id, name FROM {alias_hits_o} WHERE note IS NOT NULL")
def _(t: Tables):
    return M.flagged_names(t.institute_names, t.tier_alias).select("id", "name")


@query("flagged_entries", "SELECT DISTINCT tier, entry_pos, note FROM {tier_alias} WHERE note IS NOT NULL")
def _(t: Tables):
    return M.flagged_entries(t.tier_alias)


# An order is a degree of its customer, taught at a place named by the order's priority.
view(
    "degree_rows",
    """SELECT c_mktsegment AS role, o_custkey AS candidate_id, o_orderkey AS pos,
              CASE o_orderpriority WHEN '1-URGENT' THEN concat('B.Tech ', o_orderstatus) WHEN '2-HIGH' THEN 'Executive MBA'
                   WHEN '3-MEDIUM' THEN 'Diploma' WHEN '4-NOT SPECIFIED' THEN concat('Course ', o_orderstatus) ELSE 'PhD Physics' END AS degree,
              CASE WHEN o_totalprice < 60000 THEN '' WHEN o_orderstatus = 'F' THEN concat('Widget House ', o_orderpriority) ELSE 'Old Anvil School' END AS institution
       FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
)
view(
    "degree_reqs",
    """SELECT DISTINCT c_mktsegment AS role, r.r_regionkey AS req_id, CASE r.r_regionkey WHEN 0 THEN 'Bachelor''s in Engineering' WHEN 1 THEN 'MBA'
              WHEN 2 THEN 'Advanced studies' WHEN 3 THEN 'Course O (any)' ELSE 'BE' END AS req_name
       FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r.r_regionkey""",
)


def _tier_sql(col: str) -> str:
    clean = f"regexp_replace(lower({col}), '[.\\s]+', '', 'g')"
    arms = []
    for tier, aliases in X.DEGREE_ALIASES.items():
        forms = sorted({a.replace(".", "").replace(" ", "").replace("'", "''") for a in aliases})
        tests = " OR ".join(f"contains({clean}, '{f}') OR contains('{f}', {clean})" for f in forms)
        arms.append(f"WHEN {tests} THEN '{tier}'")
    return "CASE " + " ".join(arms) + " ELSE '' END"


def _phrase_sql(n: str, h: str) -> str:
    boundary = lambda w: f"regexp_matches(lower({h}), '\\b' || regexp_escape({w}) || '\\b')"
    toks = f"list_filter(regexp_split_to_array(lower({n}), '\\s+'), lambda t: length(t) > 2)"
    every = f"list_filter(regexp_split_to_array(lower({n}), '\\s+'), lambda t: t <> '')"
    used = f"CASE WHEN len({toks}) > 0 THEN {toks} ELSE {every} END"
    tiers = f"length(replace({n}, ' ', '')) > 5 AND {n}_tier <> '' AND ({n}_tier = {h}_tier OR ({n}_tier = 'master' AND {h}_tier = 'phd'))"
    return f"({boundary(f'lower({n})')} OR len(list_filter({used}, lambda t: {boundary('t')})) > 0 OR ({tiers}))"


view(
    "degree_verdicts_o", spark="SELECT 1",
    oracle=f"""SELECT role, degree, req_name, {_phrase_sql('req_name', 'degree')} OR {_phrase_sql('degree', 'req_name')} AS direct,
         regexp_matches(lower(req_name), 'degree|graduation|bachelor|master|education') AS generic
       FROM (SELECT d.role, degree, req_name, {_tier_sql('degree')} AS degree_tier, {_tier_sql('req_name')} AS req_name_tier
             FROM (SELECT DISTINCT role, degree FROM {{degree_rows}}) d JOIN (SELECT DISTINCT role, req_name FROM {{degree_reqs}}) r ON d.role = r.role) x""",
)
view(
    "degree_match_o", spark="SELECT 1",
    oracle="""SELECT d.role, candidate_id, req_id, bool_or(direct OR generic) AS matched,
         CASE WHEN bool_or(direct OR generic) THEN arg_min(d.degree, (NOT direct, pos)) END AS degree,
         CASE WHEN bool_or(direct OR generic) THEN arg_min(d.institution, (NOT direct, pos)) END AS institution
       FROM {degree_rows} d JOIN {degree_reqs} r ON d.role = r.role
       JOIN {degree_verdicts_o} v ON v.role = d.role AND v.degree = d.degree AND v.req_name = r.req_name GROUP BY ALL""",
)


@query("degree_match", "SELECT * FROM {degree_match_o}")
def _(t: Tables):
    return M.degree_match(t.degree_rows, t.degree_reqs)


view("doc_candidates", "SELECT source AS role, doc_id AS candidate_id, text AS raw_text FROM {documents}")
# Each source asks for the first word of its alphabetically first document, and once for nothing.
view(
    "location_reqs",
    """SELECT source AS role, 1 AS req_id, concat('Location: ', split_part(min(text), ' ', 1)) AS req_name FROM {documents} GROUP BY source
       UNION ALL SELECT source, 2, 'City' FROM {documents} GROUP BY source
       UNION ALL SELECT source, 3, concat('City: ', max(lang), 'en') FROM {documents} GROUP BY source""",
)
view(
    "location_o", spark="SELECT 1",
    oracle=r"""SELECT c.role, candidate_id, req_id, term, term <> '' AND contains(lower(raw_text), term) AS matched
       FROM {doc_candidates} c JOIN (SELECT role, req_id, trim(regexp_replace(lower(req_name), '^(location:|location|city:|city)\s*', '')) AS term FROM {location_reqs}) r
         ON c.role = r.role""",
)


@query("location_match", "SELECT * FROM {location_o}")
def _(t: Tables):
    return M.location_match(t.doc_candidates, t.location_reqs)


# Each brand is a category, spelled as the configuration does for some of them.
view(
    "routed_reqs",
    """SELECT p_type AS role, p_partkey AS req_id, CASE p_brand WHEN 'Brand#1' THEN ' Core Skills ' WHEN 'Brand#2' THEN 'Education fit' WHEN 'Brand#3' THEN 'Communication'
              WHEN 'Brand#4' THEN 'Leadership' WHEN 'Brand#5' THEN 'resume organization' ELSE p_brand END AS category,
              concat(p_name, CASE p_size WHEN 1 THEN ' in Remote city' WHEN 2 THEN ' and French' WHEN 3 THEN ', Certified' WHEN 4 THEN ' with B.Tech degree' WHEN 5 THEN ' mba'
                     WHEN 6 THEN ' mumbai' WHEN 7 THEN ' team lead' WHEN 8 THEN ' 5 years' ELSE '' END) AS req_name FROM {part}""",
)
_KIND = r"""CASE WHEN c IN ('core skills') THEN 'skill' WHEN c = 'education fit' THEN 'education' WHEN c = 'communication' THEN 'communication'
       WHEN c = 'leadership' THEN 'leadership' WHEN c = 'resume organization' THEN 'resume_organization'
       WHEN regexp_matches(n, 'location|city|relocate|remote|onsite|hybrid') THEN 'location'
       WHEN regexp_matches(n, 'language|english|hindi|spanish|french|german|chinese|japanese') THEN 'language'
       WHEN regexp_matches(n, 'certification|certificate|certified|pmp|cissp|cfa|cpa|licensed|license') THEN 'certification'
       WHEN regexp_matches(n, '\b(degree|b\.tech|btech|m\.tech|mtech|mba|b\.sc|m\.sc|bba|bca|mca|diploma|phd|graduation|education|university|college)\b') THEN 'education'
       WHEN regexp_matches(n, 'leadership|team lead|manager|managing|lead') THEN 'leadership'
       WHEN regexp_matches(n, 'experience|years|exp') THEN 'experience' ELSE 'skill' END"""
_SECTIONS = """CASE req_type WHEN 'skill' THEN ['Experience', 'Projects', 'Skills'] WHEN 'experience' THEN ['Experience'] WHEN 'leadership' THEN ['Experience']
       WHEN 'education' THEN ['Education'] WHEN 'certification' THEN ['Certifications'] WHEN 'language' THEN ['Languages'] WHEN 'location' THEN ['Personal_Info']
       WHEN 'communication' THEN ['Experience', 'Personal_Info']
       ELSE ['Experience', 'Education', 'Projects', 'Skills', 'Certifications', 'Languages', 'Personal_Info'] END"""


@query(
    "route_sections",
    f"""SELECT role, req_id, category, req_name, req_type, unnest({_SECTIONS}) AS section
        FROM (SELECT *, {_KIND} AS req_type FROM (SELECT *, lower(trim(category)) AS c, lower(req_name) AS n FROM {{routed_reqs}}) a) b""",
)
def _(t: Tables):
    return M.route_sections(t.routed_reqs)


# A document's lines are its candidate's chunks, sectioned by length; the corpus language names the skills asked for.
view(
    "section_chunks",
    spark="""SELECT source AS role, doc_id AS candidate_id, concat(doc_id, '__', line_no) AS chunk_id, line_no AS pos, line AS text,
       CASE length(line) % 5 WHEN 0 THEN 'experience' WHEN 1 THEN 'Projects' WHEN 2 THEN 'skills' WHEN 3 THEN 'Education' ELSE 'Personal_Info' END AS section,
       split(lower(line), '[^a-z]+') AS skills_asserted FROM {doc_lines}""",
    oracle="""SELECT source AS role, doc_id AS candidate_id, doc_id || '__' || line_no AS chunk_id, line_no AS pos, line AS text,
       CASE length(line) % 5 WHEN 0 THEN 'experience' WHEN 1 THEN 'Projects' WHEN 2 THEN 'skills' WHEN 3 THEN 'Education' ELSE 'Personal_Info' END AS section,
       regexp_split_to_array(lower(line), '[^a-z]+') AS skills_asserted FROM {doc_lines}""",
)
view(
    "section_reqs",
    """SELECT DISTINCT source AS role, lang AS req_id, CASE lang WHEN 'en' THEN 'This' WHEN 'fr' THEN 'Elle' WHEN 'de' THEN 'Nicht' ELSE 'Los' END AS req_name,
              CASE lang WHEN 'es' THEN 'Education' ELSE 'Core Skills' END AS category FROM {documents}""",
)
view(
    "evidence_o", spark="SELECT 1",
    oracle="""SELECT role, candidate_id, req_id, req_type, chunk_id, pos, text, total_chars, filtered_by_skill FROM (
         SELECT *, total_chars > 6000 AND n > 0 AND n < a AS filtered_by_skill FROM (
           SELECT *, sum(length(text)) OVER w AS total_chars, count(*) OVER w AS a, count(*) FILTER (WHERE skilled) OVER w AS n FROM (
             SELECT c.*, req_id, CASE category WHEN 'Education' THEN 'education' ELSE 'skill' END AS req_type,
                    category <> 'Education' AND list_contains(skills_asserted, lower(req_name)) AS skilled
             FROM {section_chunks} c JOIN {section_reqs} r ON c.role = r.role
               AND (CASE WHEN category = 'Education' THEN lower(section) = 'education' ELSE lower(section) IN ('experience', 'projects', 'skills') END)) x
           WINDOW w AS (PARTITION BY role, candidate_id, req_id)) y) z WHERE NOT filtered_by_skill OR skilled""",
)


@query("section_evidence", "SELECT role, candidate_id, req_id, req_type, chunk_id, pos, total_chars, filtered_by_skill FROM {evidence_o}")
def _(t: Tables):
    return M.section_evidence(t.section_chunks, t.section_reqs).drop("text")


@query(
    "section_evidence_text",
    """SELECT role, candidate_id, req_id, count(*) AS n_chunks, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)) AS digest
       FROM {evidence_o} GROUP BY ALL""",
)
def _(t: Tables):
    text = M.evidence_text(M.section_evidence(t.section_chunks, t.section_reqs))
    whole = text.groupBy("role", "candidate_id", "req_id").agg(F.sum("n_chunks").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("part_no", "text"))).alias("_p"))
    return whole.select("role", "candidate_id", "req_id", "n_chunks", F.md5(F.array_join("_p.text", "")).alias("digest"))


# A user's turn asks about the document with the conversation's number.
view(
    "questions",
    """SELECT concat(CAST(conv_id AS STRING), '/', CAST(turn AS STRING)) AS question_id, conv_id AS candidate_id, text AS question
       FROM {conversations} WHERE role = 'user'""",
)
view("question_chunks", "SELECT doc_id AS candidate_id, line_no AS pos, line AS text FROM {doc_lines}")
_STOP = ", ".join(f"'{w}'" for w in M.QUESTION_STOP_WORDS)


@query(
    "keyword_topk",
    f"""SELECT question_id, candidate_id, pos, n_words, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n_words DESC, pos) AS rank FROM (
            SELECT question_id, q.candidate_id, pos, len(list_filter(w, lambda x: contains(lower(text), x))) AS n_words
            FROM (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')), lambda x: x NOT IN ({_STOP})) AS w FROM {{questions}}) q
            JOIN {{question_chunks}} c ON q.candidate_id = c.candidate_id) a) b WHERE rank <= 5""",
)
def _(t: Tables):
    return M.keyword_topk(t.questions, t.question_chunks, 5).drop("text")


# Requirements named by common words of the corpus, with synonyms of their own.
view(
    "profile_lines",
    """SELECT source AS role, doc_id AS candidate_id, line_no AS pos, CASE WHEN length(line) % 4 = 0 THEN concat(line, ' for ', CAST(length(line) % 13 AS STRING), '+ Yrs') ELSE line END AS text,
              CAST(length(line) % 6 AS INT) AS section_prio,
              CASE CAST(length(line) % 6 AS INT) WHEN 0 THEN 'experience' WHEN 1 THEN 'skills' WHEN 2 THEN 'education' WHEN 3 THEN 'certifications' WHEN 4 THEN 'projects' ELSE 'summary' END AS section
       FROM {doc_lines}""",
)
view(
    "presence_reqs",
    """SELECT DISTINCT source AS role, lang AS req_id, CASE lang WHEN 'en' THEN 'The' WHEN 'fr' THEN 'La' WHEN 'de' THEN 'Und' ELSE 'Que' END AS req_name FROM {documents}""",
)
_B0, _B1 = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


_YEARS = r"\d+(?:\.\d+)?\s*\+?\s*(?:year|yr)s?"


def _windows_sql(keys: str, rows: str) -> str:
    """keys, w: the years phrases of ``text`` in rows, each with 80 characters around it."""
    at = "len(array_to_string(gap[1:i], '')) + len(array_to_string(phr[1:i - 1], ''))"
    return f"""SELECT {keys}, list_transform(range(1, len(phr) + 1), lambda i: {{'y': CAST(regexp_extract(phr[i], '^(\\d+(\\.\\d+)?)', 1) AS DOUBLE),
                 'w': substr(t, greatest({at} - 80, 0) + 1, {at} + len(phr[i]) + 80 - greatest({at} - 80, 0))}}) AS w
          FROM (SELECT *, regexp_extract_all(t, '{_YEARS}') AS phr, string_split_regex(t, '{_YEARS}') AS gap
                FROM (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM ({rows}) r) a) b"""


def _most_sql(w: str, pattern: str) -> str:
    return f"coalesce(nullif(list_max(list_transform(list_filter({w}, lambda x: regexp_matches(x.w, {pattern})), lambda x: x.y)), 0), list_max(list_transform({w}, lambda x: x.y)), 0)"


view(
    "presence_patterns_o", spark="SELECT 1",
    oracle=f"""SELECT role, req_id, CASE req_id WHEN 'en' THEN '{_B0}(the|of the|nd){_B1}' WHEN 'fr' THEN '{_B0}(la|des|le la){_B1}'
                   WHEN 'de' THEN '{_B0}(und|nicht|sch, der){_B1}' ELSE '{_B0}que{_B1}' END AS p FROM {{presence_reqs}}""",
)
view(
    "presence_windows_o", spark="SELECT 1",
    oracle=_windows_sql("role, candidate_id, section, entry", """SELECT role, candidate_id, section, CASE section WHEN 'education' THEN pos ELSE 0 END AS entry, string_agg(text, ' | ' ORDER BY pos) AS text
             FROM {profile_lines} WHERE section NOT IN ('certifications', 'projects') GROUP BY ALL"""),
)


@query(
    "presence_match",
    f"""SELECT f.role, f.candidate_id, f.req_id, f.section, f.pos, CASE WHEN f.section IN ('certifications', 'projects') THEN 0
               WHEN coalesce({_most_sql('o.w', 'f.p')}, 0) > 0 THEN {_most_sql('o.w', 'f.p')} ELSE {_most_sql('s.w', 'f.p')} END AS years
        FROM (SELECT l.role, candidate_id, req_id, p, arg_min(section, (section_prio, CASE section WHEN 'education' THEN pos ELSE 0 END, pos)) AS section, arg_min(pos, (section_prio, pos)) AS pos
              FROM {{profile_lines}} l JOIN {{presence_patterns_o}} r ON l.role = r.role AND regexp_matches(lower(text), p)
              WHERE section <> 'experience' OR length(text) >= 3 GROUP BY ALL) f
        LEFT JOIN {{presence_windows_o}} o ON o.role = f.role AND o.candidate_id = f.candidate_id AND o.section = f.section AND o.entry = CASE f.section WHEN 'education' THEN f.pos ELSE 0 END
        LEFT JOIN {{presence_windows_o}} s ON s.role = f.role AND s.candidate_id = f.candidate_id AND s.section = 'summary'""",
)
def _(t: Tables):
    words = {"the": ["of the", "nd"], "la": ["des", "le la", "c++"], "und": ["nicht", "sch, der"]}
    return M.presence_match(t.profile_lines, t.presence_reqs, words).drop("snippet")


view(
    "years_texts",
    """SELECT source AS role, doc_id AS candidate_id, concat(CAST(n_chars % 23 AS STRING), '+ years in ', lang, '. ', text, ' Then ', CAST(doc_id % 9 AS STRING), ' yrs of the rest.') AS text,
              CAST(NULL AS STRING) AS summary FROM {documents}""",
)


view("years_windows_o", spark="SELECT 1", oracle=_windows_sql("role, candidate_id", "SELECT role, candidate_id, text FROM {years_texts}"))


@query(
    "years_near_alias",
    f"""SELECT role, candidate_id, req_id, {_most_sql('w', 'p')} AS years FROM {{years_windows_o}} JOIN (
          SELECT role, req_id, CASE req_id WHEN 'en' THEN '{_B0}(the|of the|nd){_B1}' WHEN 'fr' THEN '{_B0}(la|des){_B1}'
                 WHEN 'de' THEN '{_B0}und{_B1}' ELSE '{_B0}que{_B1}' END AS p FROM {{presence_reqs}}) r USING (role)""",
)
def _(t: Tables):
    return M.years_near_alias(t.years_texts, t.presence_reqs, {"the": ["of the", "nd"], "la": ["des"]})


view(
    "expected_texts",
    """SELECT p_partkey AS req_id, p_size, form, CASE form WHEN 0 THEN concat('Relative to EXPECTED  ', CAST(p_size AS STRING), ' years, 99 years') WHEN 1 THEN concat(CAST(p_size AS STRING), '-',
              CAST(p_size + 2 AS STRING), ' years as stated') WHEN 2 THEN concat(CAST(p_size AS STRING), '.5+ years of ', p_name) WHEN 3 THEN concat('about ', CAST(p_size AS STRING), ' year') ELSE p_name END AS sq_text
       FROM (SELECT *, CAST(p_partkey % 5 AS INT) AS form FROM {part}) x""",
)


@query(
    "expected_years",
    "SELECT req_id, CAST(CASE form WHEN 0 THEN p_size WHEN 1 THEN p_size + 2 WHEN 2 THEN p_size + 0.5 WHEN 3 THEN p_size END AS DOUBLE) AS expected_years FROM {expected_texts}",
)
def _(t: Tables):
    return M.add_expected_years(t.expected_texts).select("req_id", "expected_years")


view("grade_texts", "SELECT doc_id, text FROM {documents}")
_NUM = r"(?i)\b(?:cgpa|gpa|marks|percentage)?\s*(?::|of)?\s*([0-9]+(?:\.[0-9]+)?)\s*(?:/\s*(10|4))?\b"
_PCT = r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(?:%|\s*percent)\b"


@query(
    "extract_cgpa",
    f"""SELECT doc_id, coalesce(
          list_filter(list_transform(range(len(v)), lambda i: CASE WHEN s[i + 1] <> '' OR (CAST(v[i + 1] AS DOUBLE) > 0 AND CAST(v[i + 1] AS DOUBLE) <= 10) THEN CAST(v[i + 1] AS DOUBLE) END), lambda x: x IS NOT NULL)[1],
          list_filter(list_transform(p, lambda x: CAST(x AS DOUBLE)), lambda x: x > 0 AND x <= 100)[1]) AS grade
        FROM (SELECT doc_id, regexp_extract_all(text, '{_NUM}', 1) AS v, list_transform(regexp_extract_all(text, '{_NUM}', 2), lambda x: coalesce(x, '')) AS s,
                     regexp_extract_all(text, '{_PCT}', 1) AS p FROM {{grade_texts}}) x""",
)
def _(t: Tables):
    return M.extract_grades(t.grade_texts).select("doc_id", "grade")


# Customers as candidates with degrees, certificates (their orders; no provider is named for the open ones) and a grade from the account balance.
view(
    "code_candidates",
    "SELECT c_mktsegment AS role, c_custkey AS candidate_id, concat(c_name, ' in ', n_name) AS raw_text, CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000 END AS grade FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
)
view(
    "cert_rows",
    """SELECT c_mktsegment AS role, o_custkey AS candidate_id, o_orderkey AS pos, concat('Certificate ', o_orderstatus) AS cert,
              CASE o_orderstatus WHEN 'P' THEN 'New Plate' WHEN 'O' THEN '' ELSE 'Nobody' END AS provider FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
)
view(
    "code_sub_queries",
    """SELECT role, req_id, req_name, 20.0 + req_id AS weight_pct, 'a' AS sq_key, 'Is it held?' AS sq_text, 'binary' AS kind FROM {code_reqs}
       UNION ALL SELECT role, req_id, req_name, 20.0 + req_id, 'b', 'CGPA of at least 6.5', 'cgpa' FROM {code_reqs}
       UNION ALL SELECT role, req_id, req_name, 20.0 + req_id, 'c', 'Tier of institute', 'institution_rank' FROM {code_reqs}
       UNION ALL SELECT role, req_id, req_name, 20.0 + req_id, 'd', 'Tier of provider', 'certificate_rank' FROM {code_reqs}
       UNION ALL SELECT role, req_id, req_name, 20.0 + req_id, 'e', 'How deep?', 'four_band' FROM {code_reqs}""",
)
view(
    "code_reqs",
    """SELECT role, req_id, req_name FROM {degree_reqs} UNION ALL SELECT DISTINCT c_mktsegment, 5, 'Certificate P' FROM {customer}
       UNION ALL SELECT DISTINCT c_mktsegment, 6, 'Location: NATION_1' FROM {customer}""",
)
view(
    "code_verdicts_o", spark="SELECT 1",
    oracle=f"""SELECT role, degree, req_name, {_phrase_sql('req_name', 'degree')} OR {_phrase_sql('degree', 'req_name')} OR regexp_matches(lower(req_name), 'degree|graduation|bachelor|master|education') AS hit
       FROM (SELECT d.role, degree, req_name, {_tier_sql('degree')} AS degree_tier, {_tier_sql('req_name')} AS req_name_tier
             FROM (SELECT DISTINCT role, degree FROM {{degree_rows}}) d JOIN (SELECT DISTINCT role, req_name FROM {{code_reqs}}) r ON d.role = r.role) x""",
)


@query(
    "code_only_req_score",
    """WITH hits AS (
         SELECT DISTINCT d.role, candidate_id, req_id FROM {degree_rows} d JOIN {code_verdicts_o} v ON v.role = d.role AND v.degree = d.degree AND hit
           JOIN {code_reqs} r ON r.role = v.role AND r.req_name = v.req_name
         UNION SELECT c.role, candidate_id, req_id FROM {cert_rows} c JOIN {code_reqs} r ON c.role = r.role
           WHERE (req_name = 'Certificate P') OR (req_name = 'Course O (any)' AND cert = 'nothing')
         UNION SELECT c.role, candidate_id, req_id FROM {code_candidates} c JOIN {code_reqs} r ON c.role = r.role
           WHERE req_name LIKE 'Location:%' AND contains(lower(raw_text), 'nation_1') OR contains(lower(raw_text), lower(req_name))),
       inst AS (SELECT role, candidate_id, CASE WHEN arg_min(institution, pos) LIKE 'Widget%' THEN 1.0 ELSE 1.0 END AS p FROM {degree_rows} WHERE institution <> '' GROUP BY ALL),
       prov AS (SELECT role, candidate_id, CASE WHEN arg_min(coalesce(nullif(provider, ''), cert), pos) = 'New Plate' THEN 1.0 ELSE 0.01 END AS p FROM {cert_rows} GROUP BY ALL)
       SELECT c.role, c.candidate_id, r.req_id, s AS sub_score_sum, 5 AS n_sq, round((20.0 + r.req_id) * s / 5, 4) AS contribution
       FROM {code_candidates} c JOIN {code_reqs} r ON c.role = r.role
       LEFT JOIN hits h ON h.role = c.role AND h.candidate_id = c.candidate_id AND h.req_id = r.req_id
       LEFT JOIN inst i ON i.role = c.role AND i.candidate_id = c.candidate_id LEFT JOIN prov v ON v.role = c.role AND v.candidate_id = c.candidate_id,
       LATERAL (SELECT CASE WHEN h.req_id IS NULL THEN 0 ELSE 1 END + CASE WHEN grade >= 6.5 THEN 1.0 ELSE 0.5 END
                + CASE WHEN i.p > 0.01 THEN i.p ELSE 0.5 END + CASE WHEN v.p > 0.01 THEN v.p ELSE 0.5 END + 0.01 AS s) l""",
)
def _(t: Tables):
    sub_queries = t.code_sub_queries.withColumn("weight_pct", F.col("weight_pct").cast("double"))
    return M.code_only_req_score(
        t.code_candidates, sub_queries, t.degree_rows, t.cert_rows, t.tier_alias, t.tier_alias
    )
