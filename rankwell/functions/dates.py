"""Career dates as month numbers (year * 12 + month). "Today" is always passed in as ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.functions.core import let

# How date ranges are written.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LONG_MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
PRESENT = ["present", "current", "ongoing", "now"]
_DATE = r"\d{4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{4}|\d{1,2}/\d{4}|\d{4}-\d{2}"
RANGE = rf"(?i)(\b(?:{_DATE})\b)\s*(?:-|–|—|to|until)\s*(\b(?:{_DATE}|Present|Current|Ongoing|Now)\b)"


def _int(value: Column) -> Column:
    return F.nullif(value, F.lit("")).try_cast("int")


def _month_number(name: Column) -> Column:
    pairs = [*zip(MONTHS, range(1, 13)), *zip(LONG_MONTHS, range(1, 13)), ("sept", 9)]
    table = F.map_from_arrays(*(F.array(*[F.lit(v) for v in side]) for side in zip(*dict(pairs).items())))
    return F.try_element_at(table, F.lower(name))


def single_date(token: Column) -> Column:
    """struct(year, month, is_present) of one date token; nulls when it is no date."""
    return let(F.trim(token), _single_date)


def _single_date(token: Column) -> Column:
    slash, dash, named = r"^(\d{1,2})/(\d{4})", r"^(\d{4})-(\d{2})", r"^([A-Za-z]+)\s+(\d{4})"

    def of(year: Column, month: Column, is_present: bool = False) -> Column:
        return F.struct(
            year.cast("int").alias("year"), month.cast("int").alias("month"), F.lit(is_present).alias("is_present")
        )

    def by_name() -> Column:
        return let(
            _month_number(F.regexp_extract(token, named, 1)),
            lambda m: of(F.when(m.isNotNull(), _int(F.regexp_extract(token, named, 2))), m),
        )

    nothing = of(F.lit(None), F.lit(None))
    return (
        F.when(token.isNull() | (token == ""), nothing)
        .when(F.rlike(token, F.lit(r"^\d{4}$")), of(_int(token), F.lit(None)))
        .when(F.rlike(token, F.lit(slash)), of(_int(F.regexp_extract(token, slash, 2)), _int(F.regexp_extract(token, slash, 1))))
        .when(F.rlike(token, F.lit(dash)), of(_int(F.regexp_extract(token, dash, 1)), _int(F.regexp_extract(token, dash, 2))))
        .when(F.lower(token).isin(PRESENT), of(F.lit(None), F.lit(None), True))
        .otherwise(by_name())
    )


def date_range(dates: Column, as_of: tuple[int, int]) -> Column:
    """struct(start_year, start_month, end_year, end_month, is_current, months, inferred_full_year).

    A missing start month is January, a missing end month December, both ends count. A lone date stands
    for its whole year: 12 months, marked as inferred.
    """
    ends = F.struct(F.regexp_extract(dates, RANGE, 1).alias("first"), F.regexp_extract(dates, RANGE, 2).alias("second"))
    parts = let(
        ends,
        lambda e: F.struct(
            (e["first"] != "").alias("is_range"),
            single_date(e["first"]).alias("start"),
            single_date(e["second"]).alias("end"),
            single_date(F.when(e["first"] == "", dates)).alias("alone"),
        ),
    )
    return let(parts, lambda p: _range_fields(p["is_range"], p["start"], p["end"], p["alone"], as_of))


def _range_fields(is_range: Column, start: Column, end: Column, alone: Column, as_of: tuple[int, int]) -> Column:
    current = F.coalesce(is_range & end["is_present"], F.lit(False))
    end_year = F.coalesce(end["year"], F.lit(as_of[0]))
    end_month = F.coalesce(end["month"], F.when(current, F.lit(as_of[1])))
    months = F.greatest(
        F.lit(0),
        end_year * 12 + F.coalesce(end_month, F.lit(12)) - (start["year"] * 12 + F.coalesce(start["month"], F.lit(1))) + 1,
    )
    lone = ~is_range & alone["year"].isNotNull()
    has_start = is_range & start["year"].isNotNull()
    closed = has_start & (end["year"].isNotNull() | current)
    return F.struct(
        F.when(has_start, start["year"]).when(lone, alone["year"]).alias("start_year"),
        F.when(has_start, start["month"]).when(lone, F.lit(1)).alias("start_month"),
        F.when(closed, end_year).when(lone, alone["year"]).alias("end_year"),
        F.when(closed, end_month).when(lone, F.lit(12)).alias("end_month"),
        current.alias("is_current"),
        F.when(has_start, months).when(lone, F.lit(12)).alias("months"),
        F.coalesce(lone, F.lit(False)).alias("inferred_full_year"),
    )


def month_number(text: Column, as_of: tuple[int, int]) -> Column:
    """Month number of ``YYYY-MM``, ``YYYY`` (mid-year), a present word, or the first year in the text."""
    return let(F.lower(F.trim(text)), lambda clean: _month_number_of(clean, as_of))


def _month_number_of(clean: Column, as_of: tuple[int, int]) -> Column:
    present = F.contains(clean, F.lit("present")) | F.contains(clean, F.lit("current")) | F.contains(clean, F.lit("ongoing"))
    dash = r"^(\d{4})-(\d{2})$"
    year = F.regexp_extract(clean, r"\b(19\d{2}|20\d{2})\b", 1)
    return (
        F.when(present, F.lit(as_of[0] * 12 + as_of[1]))
        .when(F.rlike(clean, F.lit(dash)), _int(F.regexp_extract(clean, dash, 1)) * 12 + _int(F.regexp_extract(clean, dash, 2)))
        .when(F.rlike(clean, F.lit(r"^\d{4}$")), _int(clean) * 12 + 6)
        .when(year != "", _int(year) * 12 + 6)
    )
