import re

import pytest
from pyspark.sql import functions as F

from rankwell.functions import dates, matching as M, splitting, text as X
from rankwell.operators import chunking as C, temporal, text as O


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(expr).collect()]


def test_headings(spark):
    lines = ["Skills & Tools", "SKILLS:", "## Work Experience ##", "My skills are many and varied indeed", "Education", "hello", ""]
    got = values(spark, [(x,) for x in lines], "line string", X.heading(F.col("line")))
    assert got == ["skills", "skills", "experience", None, "education", None, None]


def test_sections_end_at_the_next_heading(spark):
    doc = "Ann\nSummary\nx\nSkills\na, b\nSkills\nc\nEducation\nBSc"
    rows = O.sectionize(spark.createDataFrame([(1, doc)], "doc_id int, text string")).orderBy("seq").collect()
    assert [(r.section, r.text) for r in rows] == [("summary", "Ann"), ("summary", "x"), ("skills", "a, b\nSkills\nc"), ("education", "BSc")]


def test_normalize_text(spark):
    got = values(spark, [("a\r\n[--- Page 3 ---]  \r\nb\rc\n\n",)], "t string", X.normalize_text(F.col("t")))
    assert got == ["a\n\nb\nc"]


@pytest.mark.parametrize(
    ("text", "months", "current", "inferred"),
    [
        ("2017 - 2023", 84, False, False), ("Jun 2019 — Dec 2022", 43, False, False), ("2020", 12, False, True),
        ("", None, False, False), ("some random text", None, False, False), ("2020 - Present", 42, True, False),
        ("Jan 2018 – Current", 66, True, False), ("2019 — Ongoing", 54, True, False),
    ],
)
def test_date_ranges(spark, text, months, current, inferred):
    row = spark.createDataFrame([(text,)], "d string").select(dates.date_range(F.col("d"), (2023, 6)).alias("x")).first().x
    assert (row.months, row.is_current, row.inferred_full_year) == (months, current, inferred)


@pytest.mark.parametrize(
    ("spans", "months"),
    [
        ([(1, 5), (5, 9)], 9), ([(1, 5), (6, 9)], 9), ([(1, 9), (2, 3)], 9), ([(1, 5), (1, 5)], 5), ([(1, 5), (20, 21)], 7),
        ([(9, 5)], -3), ([(1, 10), (4, 2)], 10),
    ],
)
def test_merged_months(spark, spans, months):
    df = spark.createDataFrame([("c", s, e) for s, e in spans], "candidate_id string, start int, end int")
    assert temporal.merged_months(df).first().months == months


def test_experience_years(spark):
    def years(*texts):
        df = spark.createDataFrame([("c", t, "Engineer", "ACME", 1) for t in texts], "candidate_id string, dates string, title string, company string, n_details int")
        return temporal.experience_years(temporal.guard_single_years(temporal.parse_dates(df, (2024, 1)))).first().years

    assert years("2018-2020", "2020-2023") == 6.0
    assert years("2018-2022", "2020-2023") == 6.0
    assert years("2020-2023") == 4.0
    assert years("nothing") == 0.0


def test_recursive_split(spark):
    def split(text, size=500, overlap=250):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(splitting.recursive_split(size, overlap)(F.col("t"))).first()[0]

    assert split("") == [] and split("  \n ") == []
    assert split("short text") == ["short text"]
    pieces = split("a" * 1300)
    assert set("".join(pieces)) == {"a"} and [len(p) for p in pieces] == [500, 500, 500, 500, 300]
    body = "\n\n".join(f"paragraph {i} " + "word " * 40 for i in range(12))
    pieces = split(body)
    assert all(len(p) <= 500 + 250 + 1 for p in pieces)
    assert all(f"paragraph {i} " in " ".join(pieces) for i in range(12))
    plain = [p.strip() for p in body.split("\n\n")]
    assert pieces[0] == "\n\n".join(plain[:2]) and pieces[1].startswith(pieces[0][-250:].strip())
    for size, overlap in ((400, 200), (1200, 600), (1000, 400), (1000, 700)):
        with pytest.raises(ValueError):
            splitting.recursive_split(size, overlap)


def test_experience_entries(spark):
    text = (
        "Senior Engineer\nACME 2018 - 2020 Oslo\n- built things\n- led a team\nData Analyst\n2015 - 2017\n* reports\n"
        "worked directly with users, and others.\nLead Role\nNext Role\n2012"
    )
    rows = O.experience_entries(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("pos").collect()
    got = [(r.title, r.company, r.dates, r.location, r.details) for r in rows]
    assert got == [
        ("Senior Engineer", "ACME", "2018 - 2020", "Oslo", ["built things", "led a team", "Data Analyst"]),
        ("Next Role", None, "2015 - 2017", None, ["reports", "worked directly with users, and others.", "Lead Role"]),
        (None, None, "2012", None, []),
    ]
    assert O.experience_entries(spark.createDataFrame([(1, "")], "doc_id int, text string")).count() == 0


def brute_years(text, pattern):
    text = re.sub(r"\s+", " ", text.lower()).strip()
    near = best = 0.0
    for m in re.finditer(r"(\d+(?:\.\d+)?)\s*\+?\s*(?:year|yr)s?", text):
        best = max(best, float(m.group(1)))
        if re.search(pattern, text[max(0, m.start() - 80) : m.end() + 80]):
            near = max(near, float(m.group(1)))
    return near or best


def test_years_near_alias(spark):
    filler = "lorem ipsum " * 12
    texts = [
        "5 years of Python", f"9 years of sales {filler} 3+ yrs Python", f"Python {filler} 7 years", "no numbers", "",
        f"2.5 years python 10 years {filler} 12 years cobol", "1 year 2 years 3 yrs python",
    ]
    got = values(spark, [(t,) for t in texts], "t string", M.most_years(M.years_windows(F.col("t")), F.lit(r"(?i)\bpython\b")))
    assert got == [brute_years(t, r"\bpython\b") for t in texts]


def test_expected_years(spark):
    texts = ["relative to expected 3 years minimum", "3-4 years as stated in JD", "10+ years experience", "5 years of Python", "expected 2.5 years", "none"]
    assert values(spark, [(t,) for t in texts], "t string", M.expected_years(F.col("t"))) == [3, 4, 10, 5, 2.5, None]


def test_degree_tiers_and_phrases(spark):
    assert values(spark, [("MBA",), ("M.Tech",), ("PhD",), ("xyz",)], "t string", M.degree_tier(F.col("t"))) == ["bachelor", "master", "phd", ""]
    pairs = [("BA", "MBA"), ("Bachelor's Degree", "B.Tech"), ("BS", "BSE"), ("AWS Certified", "AWS Solutions Architect"), ("", "x")]
    assert values(spark, pairs, "n string, h string", M.phrase_match(F.col("n"), F.col("h"))) == [False, True, False, True, False]


def test_chunk_report(spark):
    sections = {"RoleA": {"c1": ["experience"] * 3, "c2": ["education"] * 2}, "RoleB": {"c3": [""] * 4, "c4": ["skills"]}}
    rows = [(r, c, s, "t") for r, cs in sections.items() for c, ss in cs.items() for s in ss]
    chunks = spark.createDataFrame(rows, "role string, candidate_id string, section string, text string")
    row = C.chunk_report(chunks).first()
    assert (row.total_chunks, row.total_candidates, row.empty_rate, row.mean_chunks) == (10, 4, 0.4, 2.5)
    assert (row.min_chunks, row.max_chunks, row.median_chunks, row.p95_chunks, row.finding) == (1, 4, 2.5, 4, "severe")
    counts = {(r.level, r.role or r.section or ""): r.n_chunks for r in C.chunk_counts(chunks).collect()}
    assert counts[("role", "RoleA")] == counts[("role", "RoleB")] == 5 and counts[("section", "")] == 4
