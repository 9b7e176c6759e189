"""Registered queries: documents to lines, sections, entries and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.functions import text as X
from rankwell.operators import chunking as C, text as O
from rankwell.plans.catalog import Tables, query, view

view(
    "doc_lines",
    spark="SELECT doc_id, source, line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) x AS line_no, line",
    oracle="""SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line
       FROM documents""",
)
# Headings that occur in the corpus' own short lines.
SYNONYMS = {
    "summary": ["the", "le", "la"],
    "experience": ["and", "stteen"],
    "education": ["ietzte.", "to", "tion was"],
    "skills": ["of.", "enststung ench.", "ascirr"],
    "certifications": ["released", "licensed", "all rights"],
    "projects": ["in", "und"],
    "languages": ["anquean", "hetible"],
}


def _heading_sql() -> str:
    arms = []
    for section, tokens in SYNONYMS.items():
        tests = " OR ".join(
            f"c = '{k}' OR starts_with(c, '{k} ') OR starts_with(c, '{k}&') OR w[1] = '{k}'" for k in tokens
        )
        arms.append(f"WHEN {tests} THEN '{section}'")
    return "CASE WHEN c = '' OR len(w) > 5 THEN NULL " + " ".join(arms) + " END"


view(
    "heads_o", spark="SELECT 1",
    oracle=f"""SELECT doc_id, source, line_no, line, {_heading_sql()} AS section FROM (
      SELECT *, regexp_split_to_array(c, '\\s+') AS w FROM (
        SELECT *, lower(trim(regexp_replace(trim(line), '^[ :*\\-=#•·]+|[ :*\\-=#•·]+$', '', 'g'))) AS c FROM {{doc_lines}}) a) b""",
)
view(
    "sections_o", spark="SELECT 1",
    oracle="""SELECT doc_id, seq, max(opened) AS section, min(line_no) FILTER (WHERE NOT head) AS first_line,
         regexp_replace(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT head), '^\\s+|\\s+$', '', 'g') AS text
       FROM (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY doc_id ORDER BY line_no) AS seq,
                    coalesce(last_value(CASE WHEN head THEN section END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'summary') AS opened
             FROM (SELECT *, section IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) = 1 AS head FROM {heads_o}) a) b
       GROUP BY doc_id, seq""",
)
view(
    "scanned_pages",
    "SELECT doc_id, concat(chr(10), '[--- Page 1 ---]  ', chr(13), chr(10), replace(text, chr(10), concat(chr(13), chr(10))), chr(13)) AS text FROM {documents}",
)


@query("normalize_text", r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents")
def _(t: Tables):
    return O.normalize_documents(t.scanned_pages)


@query("detect_headings", "SELECT doc_id, line_no, line, section FROM {heads_o} WHERE section IS NOT NULL")
def _(t: Tables):
    return O.detect_headings(t.doc_lines.drop("source"), SYNONYMS)


@query("sectionize", "SELECT * FROM {sections_o} WHERE text <> ''")
def _(t: Tables):
    return O.sectionize(t.documents.select("doc_id", "text"), SYNONYMS)


view(
    "elements",
    """SELECT doc_id, line_no AS pos, CASE WHEN length(line) < 40 THEN 'heading' ELSE 'text' END AS element_type, line AS text FROM {doc_lines}""",
)


@query(
    "build_sections",
    """SELECT doc_id, pos, element_type, text, section FROM (
         SELECT *, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'summary') AS section FROM (
           SELECT e.*, CASE WHEN element_type = 'heading' THEN coalesce(h.section, 'other') END AS opened
           FROM {elements} e JOIN {heads_o} h ON e.doc_id = h.doc_id AND e.pos = h.line_no WHERE trim(text) <> '') a) b
       WHERE opened IS NULL OR opened = 'other'""",
)
def _(t: Tables):
    return O.build_sections(t.elements, SYNONYMS)


@query(
    "element_offsets",
    """SELECT doc_id, pos, s AS char_start, s + length(text) AS char_end FROM (
         SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
         FROM {elements}) x""",
)
def _(t: Tables):
    return O.element_offsets(t.elements).select("doc_id", "pos", "char_start", "char_end")


@query(
    "extract_contacts",
    f"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '{X.EMAIL}'))) AS emails,
          list_sort(list_distinct(regexp_extract_all(text, '{X.PHONE}'))) AS phones,
          regexp_matches(text, '{X.LINKEDIN}') AS has_linkedin, regexp_matches(text, '{X.GITHUB}') AS has_github FROM documents""",
)
def _(t: Tables):
    found = O.extract_contacts(t.documents)
    return found.withColumn("emails", F.array_sort("emails")).withColumn("phones", F.array_sort("phones"))


@query(
    "list_items",
    r"""SELECT doc_id, count(*) AS n_items, sum(length(item)) AS n_chars FROM (
          SELECT doc_id, unnest(list_filter(list_transform(string_split(l, ','), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')) AS item
          FROM (SELECT doc_id, regexp_replace(line, '^[•*+\- ]+|[•*+\- ]+$', '', 'g') AS l FROM {doc_lines}) a WHERE contains(l, ',')
          UNION ALL SELECT doc_id, l FROM (SELECT doc_id, regexp_replace(line, '^[•*+\- ]+|[•*+\- ]+$', '', 'g') AS l FROM {doc_lines}) b
          WHERE l <> '' AND NOT contains(l, ',') AND len(list_filter(regexp_split_to_array(l, '\s+'), lambda w: w <> '')) <= 10) x GROUP BY doc_id""",
)
def _(t: Tables):
    return O.list_items(t.documents).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(F.length("item")).alias("n_chars")
    )


@query(
    "education_entries",
    r"""SELECT doc_id, min(line_no) AS first_line, regexp_replace(string_agg(l, ' ' ORDER BY line_no), '\s+', ' ', 'g') AS description
        FROM (SELECT *, count(*) FILTER (WHERE l = '' OR dated) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM (
                SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS l,
                       regexp_matches(line, '(?i)(^|[^\p{L}\p{N}_])([0-9]{4}|present|current|ongoing)([^\p{L}\p{N}_]|$)') AS dated FROM {doc_lines}) a) b
        WHERE l <> '' GROUP BY doc_id, island""",
)
def _(t: Tables):
    return O.education_entries(t.doc_lines)


@query("experience_entries")
def _(t: Tables):
    return O.experience_entries(t.documents)


# A document as a profile: its lines in turn are jobs, degrees and projects, by their length.
view(
    "doc_profiles",
    spark="""SELECT doc_id AS candidate_id, source AS role, split(text, '\\n')[0] AS summary,
       transform(filter(split(text, '\\n'), l -> length(l) % 3 = 0), l -> named_struct('title', get(split(l, ' '), 0), 'company', get(split(l, ' '), 1),
         'dates', CASE WHEN length(l) % 2 = 0 THEN concat(1990 + length(l) % 30, ' - ', 1995 + length(l) % 30) END,
         'location', CASE WHEN length(l) % 5 = 0 THEN lang END, 'details', split(l, '[.] '))) AS experience,
       transform(filter(split(text, '\\n'), l -> length(l) % 3 = 1), l -> named_struct('description', l)) AS education,
       filter(split(text, '\\n'), l -> length(l) % 3 = 2) AS projects,
       array_sort(array_distinct(filter(split(lower(text), '[^a-z]+'), w -> length(w) >= 9))) AS skills,
       filter(split(text, '\\n'), l -> l LIKE '%License%') AS certifications, array(lang) AS languages FROM {documents}""",
    oracle="""SELECT doc_id AS candidate_id, source AS role, lang, string_split(text, chr(10)) AS lines,
       list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 9))) AS skills FROM documents""",
)
view(
    "profile_chunks_o", spark="SELECT 1",
    oracle=r"""SELECT candidate_id, role, 'summary' AS section, CAST(i AS INT) AS chunk_index, p[i + 1] AS text FROM (
         SELECT candidate_id, role, p, unnest(range(len(p))) AS i FROM (
           SELECT candidate_id, role, CASE WHEN length(s) > 1200 THEN [s[1:1200], s[1081:]] WHEN s <> '' THEN [s] ELSE [] END AS p
           FROM (SELECT candidate_id, role, regexp_replace(lines[1], '^\s+|\s+$', '', 'g') AS s FROM {doc_profiles}) a) b) c
       UNION ALL SELECT candidate_id, role, section, CAST(i AS INT) AS chunk_index, regexp_replace(body, '^\s+|\s+$', '', 'g') AS text FROM (
       SELECT candidate_id, role, section, row_number() OVER (PARTITION BY candidate_id, section ORDER BY n) - 1 AS i,
              CASE section WHEN 'experience' THEN array_to_string(list_filter([
                  CASE WHEN nullif(w[1], '') IS NULL OR nullif(w[2], '') IS NULL THEN coalesce(nullif(w[1], ''), w[2]) ELSE w[1] || ' @ ' || w[2] END,
                  concat_ws(' | ', CASE WHEN length(l) % 2 = 0 THEN (1990 + length(l) % 30) || ' - ' || (1995 + length(l) % 30) END,
                            CASE WHEN length(l) % 5 = 0 THEN lang END)]
                  || list_transform(list_filter(regexp_split_to_array(l, '[.] '), lambda d: trim(d) <> ''), lambda d: '- ' || trim(d)), lambda p: p IS NOT NULL AND p <> ''), chr(10))
                ELSE l END AS body
       FROM (SELECT *, string_split(l, ' ') AS w, CASE length(l) % 3 WHEN 0 THEN 'experience' WHEN 1 THEN 'education' ELSE 'projects' END AS section
             FROM (SELECT candidate_id, role, lang, unnest(lines) AS l, unnest(range(len(lines))) AS n FROM {doc_profiles}) a) b) c
       WHERE trim(body) <> ''
       UNION ALL SELECT candidate_id, role, 'skills', 0, array_to_string(skills, ', ') FROM {doc_profiles} WHERE len(skills) > 0
       UNION ALL SELECT candidate_id, role, 'languages', 0, lang FROM {doc_profiles}
       UNION ALL SELECT candidate_id, role, 'certifications', 0, array_to_string(list_transform(list_filter(lines, lambda l: contains(l, 'License')), lambda l: trim(l)), ', ')
         FROM {doc_profiles} WHERE len(list_filter(lines, lambda l: contains(l, 'License'))) > 0""",
)


@query(
    "chunk_by_entry",
    """SELECT candidate_id || '__' || section || '__' || chunk_index AS chunk_id, candidate_id, role, section, chunk_index, text
       FROM {profile_chunks_o}""",
)
def _(t: Tables):
    return C.chunk_by_entry(t.doc_profiles).select("chunk_id", "candidate_id", "role", "section", "chunk_index", "text")


@query(
    "renumber_chunks",
    """SELECT candidate_id || '__' || n AS chunk_id, candidate_id, section, chunk_index FROM (
         SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY
           list_position(['summary', 'experience', 'education', 'projects', 'skills', 'certifications', 'languages'], section), section, chunk_index) - 1 AS n
         FROM {profile_chunks_o}) x""",
)
def _(t: Tables):
    return C.renumber_chunks(C.chunk_by_entry(t.doc_profiles)).select("chunk_id", "candidate_id", "section", "chunk_index")


# The first word of each line longer than three letters is a known skill of the document's candidate.
view(
    "line_chunks",
    """SELECT doc_id AS candidate_id, source AS role, concat(CAST(doc_id AS STRING), '__', CAST(line_no AS STRING)) AS chunk_id, line_no AS chunk_index,
              CASE CAST(length(line) % 6 AS INT) WHEN 0 THEN 'projects' WHEN 1 THEN 'experience' WHEN 2 THEN 'education' WHEN 3 THEN 'skills' WHEN 4 THEN '' ELSE 'languages' END AS section,
              line AS text FROM {doc_lines}""",
)
view(
    "candidate_skills",
    spark="""SELECT doc_id AS candidate_id, array_sort(array_distinct(filter(split(lower(text), '[^a-z]+'), w -> length(w) BETWEEN 2 AND 3))) AS skills FROM {documents}""",
    oracle="""SELECT doc_id AS candidate_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) BETWEEN 2 AND 3))) AS skills FROM documents""",
)


@query(
    "skills_asserted",
    """SELECT chunk_id, list_filter(skills, lambda s: contains(lower(text), s)
              AND s NOT IN ('and', 'or', 'the', 'with', 'using', 'use', 'used', 'for', 'to', 'in', 'of', 'a', 'an')) AS skills_asserted
       FROM {line_chunks} c JOIN {candidate_skills} k ON c.candidate_id = k.candidate_id""",
)
def _(t: Tables):
    return C.assert_skills(t.line_chunks, t.candidate_skills).select("chunk_id", "skills_asserted")


@query(
    "experience_type",
    """SELECT chunk_id, CASE WHEN section = 'projects' THEN CASE
                WHEN regexp_matches(lower(text), 'university|course|thesis|dissertation|academic|capstone') THEN 'academic'
                WHEN regexp_matches(lower(text), 'personal|side project|hobby|self-taught') THEN 'personal_project' ELSE 'professional' END
              WHEN section = 'experience' THEN 'professional' WHEN section = 'education' THEN 'academic' ELSE 'unknown' END AS experience_type
       FROM {line_chunks}""",
)
def _(t: Tables):
    return C.classify_experience(t.line_chunks).select("chunk_id", "experience_type")


view(
    "long_sections",
    "SELECT doc_id AS candidate_id, source AS section, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM {documents}",
)


@query(
    "chunk_paragraph_pack",
    r"""WITH s AS (SELECT candidate_id, section, trim(text, chr(10) || ' ') AS text FROM {long_sections}),
        packed AS (SELECT candidate_id, section, list_reduce(
             list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> ''), lambda p: {'cur': trim(p), 'out': []::VARCHAR[]}),
             lambda a, p: CASE
               WHEN length(CASE WHEN a.cur <> '' THEN ltrim(a.cur) || chr(10) || chr(10) || p.cur ELSE p.cur END) <= 1200
                 THEN {'cur': CASE WHEN a.cur <> '' THEN ltrim(a.cur) || chr(10) || chr(10) || p.cur ELSE p.cur END, 'out': a.out}
               WHEN a.cur <> '' THEN {'cur': regexp_replace(right(a.cur, 120), '^\s+', '') || chr(10) || chr(10) || p.cur, 'out': a.out || [a.cur]}
               ELSE {'cur': p.cur[1081:], 'out': a.out || [p.cur[1:1200]]} END,
             {'cur': '', 'out': []::VARCHAR[]}) AS r FROM s WHERE length(text) > 1200),
        pieces AS (SELECT candidate_id, section, r.out || CASE WHEN r.cur <> '' THEN [r.cur] ELSE [] END AS p FROM packed
                   UNION ALL SELECT candidate_id, section, [text] FROM s WHERE length(text) BETWEEN 1 AND 1200)
        SELECT candidate_id, section, unnest(range(len(p))) AS chunk_index, unnest(p) AS text FROM pieces""",
)
def _(t: Tables):
    return C.chunk_paragraph_pack(t.long_sections)


@query("chunk_recursive")
def _(t: Tables):
    return C.chunk_recursive(t.long_sections, 1000, 500)


@query(
    "chunk_report",
    """WITH n AS (SELECT role, candidate_id, count(*) AS n, count(*) FILTER (WHERE section = '') AS e FROM {line_chunks} GROUP BY role, candidate_id)
       SELECT *, CASE WHEN empty_rate >= 0.4 THEN 'severe' WHEN empty_rate >= 0.1 THEN 'notable' ELSE 'none' END AS finding,
              CASE WHEN empty_rate >= 0.4 THEN 'retire chunker' WHEN max_chunks > 50 THEN 'raise chunk size' ELSE 'healthy' END AS advice
       FROM (SELECT CAST(sum(n) AS BIGINT) AS total_chunks, count(*) AS total_candidates, round(avg(n), 2) AS mean_chunks, min(n) AS min_chunks, max(n) AS max_chunks,
                    round(sum(e) / sum(n), 4) AS empty_rate, median(n) AS median_chunks, CAST(round_even(quantile_cont(n, 0.95), 0) AS BIGINT) AS p95_chunks,
                    (SELECT arg_max(role, (s, role)) FROM (SELECT role, sum(n) AS s FROM n GROUP BY role)) AS largest_role FROM n) x""",
)
def _(t: Tables):
    return C.chunk_report(t.line_chunks)


@query(
    "chunk_counts",
    """SELECT CASE WHEN GROUPING(role) = 1 AND GROUPING(section) = 1 THEN 'total' WHEN GROUPING(section) = 1 THEN 'role' ELSE 'section' END AS level,
              role, section, count(*) AS n_chunks FROM {line_chunks} GROUP BY GROUPING SETS ((), (role), (section))""",
)
def _(t: Tables):
    return C.chunk_counts(t.line_chunks)
