"""Tenure: interval merging per candidate, and what counts as a job at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions.dates import date_range, month_number

# Titles that are section names, and the degree ladder from highest to lowest.
SECTION_TITLES = [
    "certifications", "certification", "education", "projects", "project", "skills", "skill",
    "languages", "language", "academic", "summary",
]
DEGREE_LADDER = [
    "phd", "ph.d", "doctor",
    "mtech", "m.tech", "ms", "m.s", "msc", "m.sc", "mba", "master", "post graduate", "pg",
    "btech", "b.tech", "be", "b.e", "bs", "b.s", "bsc", "b.sc", "bca", "bba", "bachelor",
    "diploma",
]


def parse_dates(entries: DataFrame, as_of: tuple[int, int]) -> DataFrame:
    """Adds the ``date_range`` fields of the ``dates`` text."""
    return entries.withColumn("_d", date_range(F.col("dates"), as_of)).select("*", "_d.*").drop("_d")


def guard_single_years(entries: DataFrame) -> DataFrame:
    """Keep an inferred full year only for what looks like a job; otherwise its months become 0.

    ``entries``: parsed entries with title, company, n_details.
    """
    company, title = F.trim(F.coalesce("company", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    year = F.when(F.rlike(company, F.lit(r"^\d{4}$")), company.try_cast("int"))
    real_company = (company != "") & ~F.coalesce(year.between(1950, 2100), F.lit(False))
    words = F.split(F.replace(F.lower(title), F.lit("/"), F.lit(" ")), r"\s+")
    is_section = F.arrays_overlap(words, F.array(*[F.lit(w) for w in SECTION_TITLES]))
    keep = real_company & ((title != "") | (F.col("n_details") > 0)) & ~is_section
    return entries.withColumn(
        "months", F.when(F.col("inferred_full_year") & ~keep, 0).otherwise(F.col("months"))
    ).withColumn("inferred_full_year", F.col("inferred_full_year") & keep)


def full_year_flags(guarded: DataFrame) -> DataFrame:
    """Flag rows for accepted inferences, for review."""
    return guarded.filter("inferred_full_year").select(
        "candidate_id", F.col("start_year").alias("year"), "dates",
        F.col("company").alias("employer"), F.col("title").alias("role_text"), F.col("months").alias("inferred_months"),
        F.lit("inferred_full_year").alias("flag_type"),
    )


def merged_months(intervals: DataFrame) -> DataFrame:
    """Months covered per candidate; intervals that overlap or share a month count once.

    ``intervals``: candidate_id, start, end (month numbers, both inclusive). Equal starts are combined
    before the shuffle, so a candidate brings at most one row per calendar month to the ordered pass,
    however many entries it has. An interval that ends before it starts counts end - start + 1 unless it
    begins inside earlier coverage.
    """
    backwards = F.col("end") < F.col("start")
    starts = intervals.groupBy("candidate_id", "start").agg(
        F.max(F.when(~backwards, F.col("end"))).alias("end"),
        F.coalesce(F.sum(F.when(backwards, F.col("end") - F.col("start") + 1)), F.lit(0)).alias("_back"),
    )
    earlier = Window.partitionBy("candidate_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max("end").over(earlier)
    outside = covered.isNull() | (F.col("start") > covered)
    fresh = (
        F.when(F.col("end").isNull(), 0)
        .when(F.col("_outside"), F.col("end") - F.col("start") + 1)
        .otherwise(F.greatest(F.lit(0), F.col("end") - F.col("_covered")))
    )
    return (
        starts.withColumn("_covered", covered)
        .withColumn("_outside", outside)
        .groupBy("candidate_id")
        .agg(F.sum(fresh + F.when(F.col("_outside"), F.col("_back")).otherwise(0)).alias("months"))
    )


def experience_months_merged(entries: DataFrame, as_of: tuple[int, int]) -> DataFrame:
    """Merged months with the title and company of the entry that ends last (the earlier entry wins ties).

    ``entries``: candidate_id, pos, title, company, start_date, end_date, is_current.
    """
    start = month_number(F.col("start_date"), as_of)
    now = F.lit(as_of[0] * 12 + as_of[1])
    parsed = entries.withColumn("start", start).filter(F.col("start") > 0)
    end = F.coalesce(month_number(F.col("end_date"), as_of), F.when(F.col("is_current"), now), F.col("start"))
    parsed = parsed.withColumn("end", end)
    latest = parsed.groupBy("candidate_id").agg(
        F.max_by(F.struct("title", "company"), F.struct(F.col("end"), (-F.col("pos")).alias("p"))).alias("_l")
    )
    return merged_months(parsed.select("candidate_id", "start", "end")).join(latest, "candidate_id").select(
        "candidate_id", F.col("months").alias("total_months"),
        F.col("_l.title").alias("latest_title"), F.col("_l.company").alias("latest_company"),
    )


def experience_years(guarded: DataFrame) -> DataFrame:
    """Years per candidate from parsed, guarded entries; the plain sum where no interval is usable."""
    usable = guarded.filter(F.col("months") > 0)
    closed = usable.filter(F.col("start_year").isNotNull() & F.col("end_year").isNotNull()).select(
        "candidate_id",
        (F.col("start_year") * 12 + F.coalesce("start_month", F.lit(1))).alias("start"),
        (F.col("end_year") * 12 + F.coalesce("end_month", F.lit(12))).alias("end"),
    )
    merged = merged_months(closed).withColumnRenamed("months", "_merged")
    summed = guarded.groupBy("candidate_id").agg(
        F.coalesce(F.sum(F.when(F.col("months") > 0, F.col("months"))), F.lit(0)).alias("_summed")
    )
    return summed.join(merged, "candidate_id", "left").select(
        "candidate_id", F.round(F.coalesce("_merged", "_summed") / 12.0, 1).alias("years")
    )


def experience_months_simple(entries: DataFrame, as_of: tuple[int, int]) -> DataFrame:
    """Sum of end - start per entry, overlaps counted twice, an open end being ``as_of``."""

    def month(text: Column) -> Column:
        text = F.trim(text)
        dash = r"^(\d{4})-(\d{2})$"
        year = F.when(F.rlike(text, F.lit(r"^\d{4}$")), text.try_cast("int") * 12 + 1)
        return F.when(
            F.rlike(text, F.lit(dash)),
            F.regexp_extract(text, dash, 1).try_cast("int") * 12 + F.regexp_extract(text, dash, 2).try_cast("int"),
        ).otherwise(year)

    open_end = F.col("is_current") | (F.coalesce("end_date", F.lit("")) == "")
    end = F.when(open_end, F.lit(as_of[0] * 12 + as_of[1])).otherwise(month(F.col("end_date")))
    span = end - month(F.col("start_date"))
    return entries.groupBy("candidate_id").agg(
        F.coalesce(F.sum(F.greatest(span, F.lit(0))), F.lit(0)).alias("total_months")
    )


def highest_degree(degrees: DataFrame) -> DataFrame:
    """The degree highest on the ladder per candidate, else its first one. ``degrees``: candidate_id, pos, degree."""
    text = F.lower(F.coalesce("degree", F.lit("")))
    rung = F.coalesce(
        *[F.when(F.contains(text, F.lit(word)), F.lit(i)) for i, word in enumerate(DEGREE_LADDER)],
        F.lit(len(DEGREE_LADDER)),
    )
    return degrees.groupBy("candidate_id").agg(F.min_by("degree", F.struct(rung, F.col("pos"))).alias("highest_degree"))
