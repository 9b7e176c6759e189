"""Whole-word matching, degree equivalence, years phrases and requirement routing as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.functions.bands import has_any
from rankwell.functions.core import let

# Degree abbreviations and names per tier, in the order they are tried.
DEGREE_ALIASES = {
    "bachelor": [
        "b.tech", "btech", "b.e.", "be", "b.e", "b.sc", "bsc", "b.sc.", "b.a", "ba", "b.a.", "bs", "b.s", "b.s.",
        "bca", "bba", "b.com", "bcom", "b.com.", "bachelor", "bachelors", "bachelor's", "undergraduate", "ug",
        "honours", "associate", "diploma", "mca",
    ],
    "master": [
        "m.tech", "mtech", "m.e.", "me", "m.e", "m.sc", "msc", "m.sc.", "m.a", "ma", "m.a.", "ms", "m.s", "m.s.",
        "mba", "m.b.a", "m.b.a.", "mca", "master", "masters", "master's", "postgraduate", "post-graduate", "pg",
        "m.phil", "mphil", "advanced degree", "advanced", "graduate degree",
    ],
    "phd": [
        "phd", "ph.d", "ph.d.", "doctorate", "doctoral", "d.phil", "d.sc", "dsc", "doctor of philosophy",
    ],
}
GENERIC_DEGREE = ["degree", "graduation", "bachelor", "master", "education"]

# Requirement types, the sections their evidence lies in, and the words that tell the type.
SECTIONS_OF_TYPE = {
    "skill": ["Experience", "Projects", "Skills"],
    "experience": ["Experience"],
    "leadership": ["Experience"],
    "same_role": ["Experience"],
    "domain": ["Experience", "Projects"],
    "education": ["Education"],
    "certification": ["Certifications"],
    "project": ["Projects", "Experience"],
    "language": ["Languages"],
    "location": ["Personal_Info"],
    "communication": ["Experience", "Personal_Info"],
    "resume_organization": [
        "Experience", "Education", "Projects", "Skills", "Certifications", "Languages", "Personal_Info",
    ],
}
TYPE_OF_CATEGORY = {
    "skill": [
        "core skills", "core skills & technologies", "technology & tools", "technology and tools", "technical skills",
        "skills", "tools", "programming", "programming languages", "technology stack experience",
    ],
    "experience": ["experience", "relevant experience", "overall relevant experience"],
    "same_role": ["same role experience", "same-role experience"],
    "leadership": ["leadership experience", "leadership", "management experience"],
    "domain": ["industry experience", "product company experience"],
    "education": ["education", "education fit", "academic"],
    "certification": ["certifications", "certification", "certification alignment"],
    "project": ["projects", "project relevance", "project experience"],
    "language": ["languages", "language", "language capabilities"],
    "location": ["location"],
    "communication": ["communication quality", "communication"],
    "resume_organization": ["resume organization"],
}
NAME_WORDS = [
    ("location", ["location", "city", "relocate", "remote", "onsite", "hybrid"]),
    ("language", ["language", "english", "hindi", "spanish", "french", "german", "chinese", "japanese"]),
    ("certification", ["certification", "certificate", "certified", "pmp", "cissp", "cfa", "cpa", "licensed", "license"]),
]
EDUCATION_WORDS = [
    "degree", "b.tech", "btech", "b.e.", "m.tech", "mtech", "mba", "b.sc", "m.sc", "bba", "bca", "mca", "diploma",
    "phd", "graduation", "education", "university", "college",
]
LATE_NAME_WORDS = [
    ("leadership", ["leadership", "team lead", "manager", "managing", "lead"]),
    ("experience", ["experience", "years", "exp"]),
]
YEARS = r"\d+(?:\.\d+)?\s*\+?\s*(?:year|yr)s?"
EXPECTED = [
    (r"expected\s+(\d+(?:\.\d+)?)\s*years?", 1),
    (r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*years?", 2),
    (r"(\d+(?:\.\d+)?)\s*\+\s*years?", 1),
    (r"(\d+(?:\.\d+)?)\s*years?\b", 1),
]


def squash(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quoted(word: Column) -> Column:
    """Regex matching ``word`` literally between word boundaries."""
    return F.concat(F.lit(r"(?U)\b\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))


def whole_word(text: Column, word: Column) -> Column:
    return F.rlike(text, quoted(word))


def tokens(text: Column) -> Column:
    """Distinct word tokens of lower-cased text, and the empty token, which every text has."""
    return F.array_distinct(F.array_append(F.split(F.lower(text), r"(?U)\W+"), F.lit("")))


def first_token(alias: Column) -> Column:
    """The token a text must have for ``alias`` to occur in it as a whole word."""
    return F.regexp_extract(F.lower(alias), r"(?U)\w+", 0)


def degree_tier(text: Column) -> Column:
    """bachelor, master or phd, else an empty string; aliases match as substrings in either direction."""

    def find(clean: Column) -> Column:
        out = None
        for tier, aliases in DEGREE_ALIASES.items():
            forms = sorted({a.replace(".", "").replace(" ", "") for a in aliases})
            hit = reduce(
                lambda a, b: a | b, (F.contains(clean, F.lit(f)) | F.contains(F.lit(f), clean) for f in forms)
            )
            out = F.when(hit, tier) if out is None else out.when(hit, tier)
        return out.otherwise("")

    return let(F.regexp_replace(F.lower(text), r"[.\s]+", ""), find)


def phrase_match(needle: Column, haystack: Column) -> Column:
    """The needle's phrase or one of its longer tokens occurs as a whole word, or both are the same degree tier.

    Tiers are compared only for needles of more than five characters; a doctorate satisfies a master's.
    """

    def test(x: Column) -> Column:
        n, h = x["n"], x["h"]
        every = F.filter(F.split(n, r"\s+"), lambda t: t != "")
        longer = F.filter(every, lambda t: F.length(t) > 2)
        used = F.when(F.size(longer) > 0, longer).otherwise(every)
        same_tier = let(
            F.struct(degree_tier(n).alias("n"), degree_tier(h).alias("h")),
            lambda t: (t["n"] != "") & ((t["n"] == t["h"]) | ((t["n"] == "master") & (t["h"] == "phd"))),
        )
        return (
            whole_word(h, n)
            | F.exists(used, lambda t: whole_word(h, t))
            | ((F.length(F.replace(n, F.lit(" "), F.lit(""))) > 5) & same_tier)
        )

    both = F.struct(F.lower(F.coalesce(needle, F.lit(""))).alias("n"), F.lower(F.coalesce(haystack, F.lit(""))).alias("h"))
    return let(both, lambda x: (x["n"] != "") & (x["h"] != "") & test(x))


def location_term(name: Column) -> Column:
    low = F.lower(name)
    return F.trim(F.regexp_replace(low, r"^(location:|location|city:|city)\s*", ""))


def expected_years(text: Column) -> Column:
    """Target years: ``expected N years``, the upper end of a range, ``N+ years``, ``N years``, in this order."""
    return let(
        squash(text),
        lambda t: F.coalesce(
            *[F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).try_cast("double") for pattern, group in EXPECTED]
        ),
    )


def years_windows(text: Column, reach: int = 80) -> Column:
    """Each phrase of years of a text, with what stands within ``reach`` characters of it: array of (years, window).

    Cutting the text at its years phrases gives each phrase's position, so overlapping windows are fine.
    """
    none = F.array().cast("array<struct<years: double, window: string>>")

    def scan(t: Column) -> Column:
        phrases = F.regexp_extract_all(t, F.lit(f"({YEARS})"), F.lit(1))
        gaps = F.split(t, YEARS)
        start = F.struct(F.lit(0).alias("pos"), none.alias("found"))

        def step(s: Column, x: Column) -> Column:
            at = s["pos"] + F.length(x["gap"])
            left = F.greatest(at - reach, F.lit(0))
            window = F.substr(t, left + 1, at + F.length(x["phrase"]) + reach - left)
            years = F.regexp_extract(x["phrase"], r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
            found = F.concat(s["found"], F.array(F.struct(years.alias("years"), window.alias("window"))))
            return F.struct((at + F.length(x["phrase"])).alias("pos"), found.alias("found"))

        rows = F.zip_with(F.slice(gaps, 1, F.size(phrases)), phrases, lambda g, p: F.struct(g.alias("gap"), p.alias("phrase")))
        return F.aggregate(rows, start, step, lambda s: s["found"])

    return F.coalesce(let(squash(text), scan), none)


def most_years(windows: Column, pattern: Column) -> Column:
    """Most years of the windows in which ``pattern`` occurs, else of all; 0 without any."""
    near = F.array_max(F.transform(F.filter(windows, lambda w: F.rlike(w["window"], pattern)), lambda w: w["years"]))
    return F.coalesce(F.when(near > 0, near), F.array_max(F.transform(windows, lambda w: w["years"])), F.lit(0.0))


def requirement_type(category: Column, name: Column) -> Column:
    """Type by exact category, else by words of the name, else skill."""

    def by_name(low: Column) -> Column:
        out = None
        for kind, needles in NAME_WORDS:
            out = F.when(has_any(low, needles), kind) if out is None else out.when(has_any(low, needles), kind)
        education = reduce(lambda a, b: a | b, (whole_word(low, F.lit(w)) for w in EDUCATION_WORDS))
        out = out.when(education, "education")
        for kind, needles in LATE_NAME_WORDS:
            out = out.when(has_any(low, needles), kind)
        return out.otherwise("skill")

    clean = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    exact = F.coalesce(*[F.when(clean.isin(names), kind) for kind, names in TYPE_OF_CATEGORY.items()])
    return F.coalesce(exact, let(F.lower(F.coalesce(name, F.lit(""))), by_name))


def sections_of(kind: Column) -> Column:
    out = F.coalesce(
        *[F.when(kind == k, F.array(*[F.lit(s) for s in names])) for k, names in SECTIONS_OF_TYPE.items()]
    )
    return F.coalesce(out, F.array(*[F.lit(s) for s in SECTIONS_OF_TYPE["resume_organization"]]))


def grade(text: Column) -> Column:
    """First grade in the text: any number with a /10 or /4 scale, or a bare one in (0, 10]; else a percentage."""
    number = r"(?iU)\b(?:cgpa|gpa|marks|percentage)?\s*(?::|of)?\s*([0-9]+(?:\.[0-9]+)?)\s*(?:/\s*(10|4))?\b"
    percent = r"(?iU)\b([0-9]+(?:\.[0-9]+)?)\s*(?:%|\s*percent)\b"

    def first(pattern: str, scaled: bool, top: float) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        scales = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if scaled else F.transform(values, lambda v: F.lit(""))
        rows = F.zip_with(values, scales, lambda v, s: F.struct(v.try_cast("double").alias("v"), s.alias("s")))
        usable = F.filter(rows, lambda r: (F.coalesce(r["s"], F.lit("")) != "") | ((r["v"] > 0) & (r["v"] <= top)))
        return F.get(usable, 0)["v"]

    return F.coalesce(first(number, True, 10.0), first(percent, False, 100.0))
