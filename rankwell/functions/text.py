"""Line and section expressions. Everything here works within a row, so a corpus is never shuffled for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.functions.core import let

# Section names with the headings that open them, in order of precedence, and field patterns.
SECTION_SYNONYMS = {
    "summary": ["summary", "professional summary", "profile", "about me"],
    "experience": ["experience", "work experience", "professional experience", "employment history"],
    "education": ["education", "academic background", "academic qualifications"],
    "skills": ["skills", "technical skills", "tools", "competencies"],
    "certifications": ["certifications", "certificates", "licenses"],
    "projects": ["projects", "selected projects", "project experience"],
    "languages": ["languages", "language skills"],
}
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = (
    r"(?:(?:\+?\d{1,3}[\s\-\.])?(?:\(\d{2,4}\)[\s\-\.]?)?\d{2,4}[\s\-\.]{1,2}\d{2,4}[\s\-\.]{1,2}\d{2,4})"
)
LINKEDIN = r"linkedin\.com/[a-zA-Z0-9_\-/]+"
GITHUB = r"github\.com/[a-zA-Z0-9_\-/]+"
DATES = (
    r"(?i)\b(?:\d{4}|Present|Current|Ongoing)"
    r"(?:\s*(?:-|–|—|to)\s*(?:\d{4}|Present|Current|Ongoing))?\b"
)
PAGE_MARK = r"(?md)^\[--- Page \d+ ---\]\s*$"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_chars(text: Column, chars: str) -> Column:
    """Without leading and trailing characters of a regex class body."""
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def normalize_text(text: Column) -> Column:
    """Unix line ends, no page markers, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), PAGE_MARK, ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def heading(line: Column, synonyms: dict[str, list[str]] = SECTION_SYNONYMS) -> Column:
    """Section a line opens, or null. A heading has at most five words and starts with a known one."""

    def match(clean: Column) -> Column:
        text, first, out = clean["text"], clean["words"][0], None
        for section, tokens in synonyms.items():
            hit = F.lit(False)
            for token in tokens:
                hit = hit | (text == token) | F.startswith(text, F.lit(token + " "))
                hit = hit | F.startswith(text, F.lit(token + "&")) | (first == token)
            out = F.when(hit, section) if out is None else out.when(hit, section)
        return F.when((text != "") & (F.size(clean["words"]) <= 5), out)

    clean = F.lower(strip(strip_chars(strip(line), r" :*\-=#•·")))
    return let(clean, lambda c: let(F.struct(c.alias("text"), F.split(c, r"\s+").alias("words")), match))


def sections(text: Column, synonyms: dict[str, list[str]] = SECTION_SYNONYMS) -> Column:
    """array<struct(seq, section, first_line, text)>: lines below each first heading, up to the next one.

    Lines above any heading form a ``summary``; later headings of a known section are plain lines.
    """

    def split(d: Column) -> Column:
        heads = F.filter(
            F.transform(d, lambda line, i: F.struct(i.alias("at"), heading(line, synonyms).alias("section"))),
            lambda h: h["section"].isNotNull(),
        )

        def cut(h: Column) -> Column:
            firsts = F.filter(h, lambda x, k: F.array_position(F.transform(h, lambda y: y["section"]), x["section"]) == k + 1)
            top = F.array(F.struct(F.lit(-1).alias("at"), F.lit("summary").alias("section")))
            return let(
                F.concat(top, firsts),
                lambda opens: F.transform(
                    opens,
                    lambda o, k: let(
                        F.coalesce(F.get(opens, k + 1)["at"], F.size(d)),
                        lambda end: F.struct(
                            k.alias("seq"),
                            o["section"].alias("section"),
                            (o["at"] + 1).alias("first_line"),
                            strip(F.array_join(F.slice(d, o["at"] + 2, end - o["at"] - 1), "\n")).alias("text"),
                        ),
                    ),
                ),
            )

        return F.filter(let(heads, cut), lambda s: s["text"] != "")

    return let(F.split(text, "\n"), split)


def list_items(text: Column) -> Column:
    """Items of a list section: comma-separated parts, or whole lines of at most ten words."""

    def items(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, ","), strip), lambda p: p != "")
        return (
            F.when(line == "", F.array().cast("array<string>"))
            .when(F.contains(line, F.lit(",")), parts)
            .when(F.size(words(line)) <= 10, F.array(line))
            .otherwise(F.array().cast("array<string>"))
        )

    lines = F.transform(F.split(text, r"\r?\n"), lambda line: strip_chars(line, r"•*+\- "))
    return F.flatten(F.transform(lines, items))


def contains_skill(text: Column, skills: Column) -> Column:
    """The known skills that occur in the text, stop-words left out."""
    stop = ["and", "or", "the", "with", "using", "use", "used", "for", "to", "in", "of", "a", "an"]
    return let(
        F.lower(text),
        lambda low: F.filter(skills, lambda s: F.contains(low, F.lower(s)) & ~F.lower(s).isin(stop)),
    )


def experience_type(text: Column, section: Column) -> Column:
    """professional, personal_project, academic or unknown."""
    low = F.lower(text)

    def any_of(*needles: str) -> Column:
        out = F.lit(False)
        for needle in needles:
            out = out | F.contains(low, F.lit(needle))
        return out

    project = (
        F.when(any_of("university", "course", "thesis", "dissertation", "academic", "capstone"), "academic")
        .when(any_of("personal", "side project", "hobby", "self-taught"), "personal_project")
        .otherwise("professional")
    )
    return (
        F.when(section == "projects", project)
        .when(section == "experience", "professional")
        .when(section == "education", "academic")
        .otherwise("unknown")
    )
