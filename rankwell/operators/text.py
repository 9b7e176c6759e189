"""Documents to lines, sections, entries and elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions import splitting, text as X


def normalize_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", X.normalize_text(F.col("text")))


def lines(docs: DataFrame) -> DataFrame:
    """One row per line, numbered from 0; other document columns stay."""
    return docs.select(
        *[c for c in docs.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def detect_headings(doc_lines: DataFrame, synonyms: dict[str, list[str]] = X.SECTION_SYNONYMS) -> DataFrame:
    return doc_lines.withColumn("section", X.heading(F.col("line"), synonyms)).filter(F.col("section").isNotNull())


def sectionize(docs: DataFrame, synonyms: dict[str, list[str]] = X.SECTION_SYNONYMS) -> DataFrame:
    """One row per section of a document: seq, section, first_line, text.

    A section's text ends at the next heading, like its offsets.
    """
    return docs.select(
        *[c for c in docs.columns if c != "text"], F.explode(X.sections(F.col("text"), synonyms)).alias("_s")
    ).select("*", "_s.*").drop("_s")


def build_sections(elements: DataFrame, synonyms: dict[str, list[str]] = X.SECTION_SYNONYMS) -> DataFrame:
    """Elements with the section of the last heading above them; unknown headings open ``other`` and stay.

    ``elements``: doc_id, pos, element_type, text.
    """
    opened = F.when(F.col("element_type") == "heading", F.coalesce(X.heading(F.col("text"), synonyms), F.lit("other")))
    above = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        elements.filter(X.strip(F.col("text")) != "")
        .withColumn("_open", opened)
        .withColumn("section", F.coalesce(F.last("_open", ignorenulls=True).over(above), F.lit("summary")))
        .filter(F.col("_open").isNull() | (F.col("_open") == "other"))
        .drop("_open")
    )


def element_offsets(elements: DataFrame, separator: int = 2) -> DataFrame:
    """Character span of each element in the document joined by a separator of that many characters."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return elements.withColumn(
        "char_start", F.coalesce(F.sum(F.length("text") + separator).over(before), F.lit(0))
    ).withColumn("char_end", F.col("char_start") + F.length("text"))


def extract_contacts(docs: DataFrame) -> DataFrame:
    """Distinct e-mails and phones in order of appearance, and whether profile links occur."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.array_distinct(F.regexp_extract_all(text, F.lit(X.EMAIL), F.lit(0))).alias("emails"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(X.PHONE), F.lit(0))).alias("phones"),
        F.rlike(text, F.lit(X.LINKEDIN)).alias("has_linkedin"),
        F.rlike(text, F.lit(X.GITHUB)).alias("has_github"),
    )


def list_items(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(X.list_items(F.col("text"))).alias("pos", "item"))


def education_entries(doc_lines: DataFrame) -> DataFrame:
    """Consecutive lines as one entry each; a blank line or a line with dates starts the next.

    ``doc_lines``: doc_id, line_no, line. Lines of one document come from one row, so its windows are small.
    """
    line = X.strip(F.col("line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opens = (line == "") | F.rlike(line, F.lit(X.DATES))
    return (
        doc_lines.withColumn("_l", line)
        .withColumn("_island", F.count_if(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("_l") != "")
        .groupBy("doc_id", "_island")
        .agg(
            F.min("line_no").alias("first_line"),
            F.array_sort(F.collect_list(F.struct("line_no", "_l"))).alias("_x"),
        )
        .select(
            "doc_id", "first_line",
            F.regexp_replace(F.array_join(F.transform("_x", lambda x: x["_l"]), " "), r"\s+", " ").alias("description"),
        )
    )


def experience_entries(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.posexplode(splitting.experience_entries(F.col("text"))).alias("pos", "_e")
    ).select("doc_id", "pos", "_e.*")


