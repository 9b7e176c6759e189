"""Scoring bands and sub-query classification, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that decide a sub-query's kind, and qualitative level words per band.
TIER_WORDS = ["tier", "prestige", "ranking", "ranked"]
INSTITUTE_WORDS = ["institute", "institution", "university", "college", "school"]
CERTIFICATE_WORDS = ["certif", "provider", "certification", "credential"]
GRADE_WORDS = ["cgpa", "percentage", "marks", "grade"]
HIGH_WORDS = ["substantial", "high", "strong", "expert", "meets-or-exceeds"]
MIDDLE_WORDS = ["some", "moderate", "medium", "partial"]
LOW_WORDS = ["few", "basic", "low", "limited", "minimal"]
YEARS_PHRASES = [
    "how many years", "years of", "years in", "years relevant",
    "years experience", "number of years", "total years",
]


def has_any(text: Column, words: Iterable[str]) -> Column:
    """True when the text contains one of the words as a substring."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def subquery_kind(text: Column, key: Column, sq_type: Column) -> Column:
    """binary, cgpa, institution_rank, certificate_rank or four_band."""
    text, key, sq_type = (F.lower(F.coalesce(c, F.lit(""))) for c in (text, key, sq_type))
    both = F.concat_ws("\n", text, key)
    tier, inst, cert = (has_any(both, w) for w in (TIER_WORDS, INSTITUTE_WORDS, CERTIFICATE_WORDS))
    return (
        F.when(sq_type.isin("binary", "boolean", "bool"), "binary")
        .when(has_any(text, GRADE_WORDS), "cgpa")
        .when(has_any(key, ["institute_tier", "institution_rank"]), "institution_rank")
        .when(has_any(key, ["provider_tier", "certificate_rank", "cert_tier"]), "certificate_rank")
        .when(tier & cert, "certificate_rank")
        .when(tier & inst, "institution_rank")
        .otherwise("four_band")
    )


def is_years_subquery(text: Column, scale: Column, method: Column) -> Column:
    """A years-proportional question: it speaks of years and has a strong phrase or a formula."""
    text, scale, method = (F.lower(F.coalesce(c, F.lit(""))) for c in (text, scale, method))
    signal = has_any(text, ["year", "relative"]) | has_any(scale, ["year"])
    strong = (
        has_any(text, ["relative to expected"])
        | (has_any(text, ["how many years"]) & has_any(text, ["expected"]))
        | (has_any(text, ["years of"]) & has_any(text, ["relative to"]))
    )
    return signal & (strong | has_any(method, ["formula", "min("]))


def qualitative_band(level: Column) -> Column:
    level = F.lower(F.coalesce(level, F.lit("")))
    return (
        F.when(has_any(level, HIGH_WORDS), 1.0)
        .when(has_any(level, MIDDLE_WORDS), 0.5)
        .when(has_any(level, LOW_WORDS), 0.25)
        .otherwise(0.01)
    )


def years_band(years: Column, target: Column) -> Column:
    return (
        F.when(years.isNull() | (F.coalesce(target, F.lit(0.0)) <= 0), 0.01)
        .when(years >= target, 1.0)
        .when(years >= 0.5 * target, 0.5)
        .when(years >= 0.25 * target, 0.25)
        .otherwise(0.01)
    )


def grade_band(score: Column, target: Column) -> Column:
    """1.0 at or above target, else 0.5; percent and ten-point grades are brought to the target's scale."""
    scaled = (
        F.when((target > 10) & (score <= 10), score * 10).when((target <= 10) & (score > 10), score / 10).otherwise(score)
    )
    return F.when(scaled >= target, 1.0).otherwise(0.5)


def tier_band(points: Column) -> Column:
    """Tier points; an unlisted or missing name is neutral."""
    return F.when(points > 0.01, points).otherwise(0.5)


def binary_score(met: Column) -> Column:
    return F.when(met, 1.0).otherwise(0.0)
