"""Profiles and sections to chunks, and what the chunk corpus looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions import splitting, text as X
from rankwell.functions.core import let

# Fixed order of sections when chunks are numbered across a candidate.
SECTION_ORDER = ["summary", "experience", "education", "projects", "skills", "certifications", "languages"]


def entry_text(entry: Column, fields: list[str]) -> Column:
    """A job or degree entry as a readable block; fields the entry type lacks count as empty."""

    def get(name: str) -> Column:
        return F.nullif(X.strip(F.coalesce(entry[name], F.lit(""))), F.lit("")) if name in fields else F.lit(None).cast("string")

    job = F.concat_ws(" @ ", get("title"), get("company"))
    degree = F.when(get("degree").isNotNull(), F.concat_ws(" in ", get("degree"), get("specialization")))
    school = F.coalesce(get("institution_normalized"), get("institution_raw"))
    study = F.concat_ws(" at ", degree, school)
    place = F.concat_ws(" | ", get("dates"), get("location"))
    details = F.filter(F.transform(F.coalesce(entry["details"], F.array()), X.strip), lambda d: d != "") if "details" in fields else F.array().cast("array<string>")
    parts = F.concat(
        F.array(job, study, F.coalesce(get("description"), F.lit("")), place),
        F.transform(details, lambda d: F.concat(F.lit("- "), d)),
    )
    return X.strip(F.array_join(F.filter(parts, lambda p: p != ""), "\n"))


def _fields(df: DataFrame, column: str) -> list[str]:
    return df.schema[column].dataType.elementType.names


def chunk_by_entry(profiles: DataFrame) -> DataFrame:
    """Chunks of a profile: one per job, degree and project, one per list, packed pieces of the summary.

    ``profiles``: candidate_id, role, summary, experience array<struct>, education array<struct>, projects,
    skills, certifications, languages (array<string>). A profile is one row and stays within its task.
    """
    skills = F.coalesce("skills", F.array().cast("array<string>"))

    def chunk(section: str, index: Column, body: Column, asserted: bool) -> Column:
        return let(
            body,
            lambda b: F.struct(
                F.lit(section).alias("section"), index.cast("int").alias("chunk_index"), b.alias("text"),
                (X.contains_skill(b, skills) if asserted else F.array().cast("array<string>")).alias("skills_asserted"),
                (X.experience_type(b, F.lit(section)) if asserted else F.lit("unknown")).alias("experience_type"),
            ),
        )

    def entries(section: str, render) -> Column:
        return F.transform(F.col(section), lambda e, i: chunk(section, i, render(e), True))

    jobs, degrees = _fields(profiles, "experience"), _fields(profiles, "education")

    def degree_text(e: Column) -> Column:
        described = X.strip(F.coalesce(e["description"], F.lit(""))) if "description" in degrees else F.lit("")
        return F.when(described != "", described).otherwise(entry_text(e, degrees))

    def whole_list(field: str) -> Column:
        items = F.filter(F.transform(F.col(field), X.strip), lambda x: x != "")
        return F.array(chunk(field, F.lit(0), F.array_join(items, ", "), False))

    parts = [
        F.transform(splitting.pack_paragraphs(F.col("summary")), lambda p, i: chunk("summary", i, p, False)),
        entries("experience", lambda e: entry_text(e, jobs)),
        entries("education", degree_text),
        entries("projects", X.strip),
        *[whole_list(f) for f in ("skills", "certifications", "languages")],
    ]
    empty = F.array().cast(
        "array<struct<section:string,chunk_index:int,text:string,skills_asserted:array<string>,experience_type:string>>"
    )
    return (
        profiles.select("candidate_id", "role", F.explode(F.concat(*[F.coalesce(p, empty) for p in parts])).alias("_c"))
        .select("candidate_id", "role", "_c.*")
        .filter(F.coalesce(F.col("text"), F.lit("")) != "")
        .withColumn("chunk_id", F.concat_ws("__", F.col("candidate_id").cast("string"), "section", F.col("chunk_index").cast("string")))
    )


def fallback_chunks(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds the raw evidence chunks of candidates for whom no structured chunk exists."""
    missing = evidence.join(chunks.select("candidate_id").distinct(), "candidate_id", "left_anti")
    return chunks.unionByName(missing, allowMissingColumns=True)


def chunk_paragraph_pack(sections: DataFrame) -> DataFrame:
    """Free-text sections as packed pieces. ``sections``: candidate_id, section, text."""
    return sections.select(
        "candidate_id", "section", F.posexplode(splitting.pack_paragraphs(F.col("text"))).alias("chunk_index", "piece")
    ).withColumnRenamed("piece", "text")


def chunk_recursive(sections: DataFrame, size: int = 1000, overlap: int = 500) -> DataFrame:
    """Sections split by the separator ladder with overlap. ``sections``: candidate_id, section, text."""
    split = splitting.recursive_split(size, overlap)
    return sections.select(
        "candidate_id", "section", F.posexplode(split(F.col("text"))).alias("chunk_index", "piece")
    ).withColumnRenamed("piece", "text")


def renumber_chunks(chunks: DataFrame) -> DataFrame:
    """Numbers chunks 0.. per candidate over sections in their fixed order; unknown sections come last."""
    order = F.coalesce(
        *[F.when(F.col("section") == s, F.lit(i)) for i, s in enumerate(SECTION_ORDER)], F.lit(len(SECTION_ORDER))
    )
    w = Window.partitionBy("candidate_id").orderBy(order, "section", "chunk_index")
    number = F.row_number().over(w) - 1
    return chunks.withColumn("chunk_no", number).withColumn(
        "chunk_id", F.concat_ws("__", F.col("candidate_id").cast("string"), F.col("chunk_no").cast("string"))
    )


def assert_skills(chunks: DataFrame, skills: DataFrame) -> DataFrame:
    """Adds the candidate's known skills found in each chunk. ``skills``: candidate_id, skills array."""
    return (
        chunks.join(skills, "candidate_id", "left")
        .withColumn("skills_asserted", X.contains_skill(F.col("text"), F.coalesce("skills", F.array().cast("array<string>"))))
        .drop("skills")
    )


def classify_experience(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("experience_type", X.experience_type(F.col("text"), F.col("section")))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks in total, per role and per section in one pass; ``level`` tells which."""
    section = F.coalesce("section", F.lit(""))
    return (
        chunks.withColumn("section", section)
        .groupingSets([[], ["role"], ["section"]], "role", "section")
        .agg(F.count(F.lit(1)).alias("n_chunks"), F.grouping_id().alias("_g"))
        .select(
            F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "role").otherwise("section").alias("level"),
            "role", "section", "n_chunks",
        )
    )


def chunk_report(chunks: DataFrame) -> DataFrame:
    """One row on the corpus: totals, chunks per candidate, share without section, finding and advice."""
    per_candidate = chunks.groupBy("role", "candidate_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("section", F.lit("")) == "").alias("_empty")
    )
    sizes = per_candidate.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum("_empty").alias("e"))
    roles = per_candidate.groupBy("role").agg(F.sum("n").alias("t"))
    # Both summaries are short; one pass over their union gives the single row.
    both = sizes.unionByName(roles, allowMissingColumns=True)
    total, weight = F.sum(F.col("n") * F.col("c")), F.coalesce("c", F.lit(0))
    return (
        both.agg(
            F.coalesce(total, F.lit(0)).alias("total_chunks"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("total_candidates"),
            F.round(total / F.sum("c"), 2).alias("mean_chunks"),
            F.min("n").alias("min_chunks"),
            F.max("n").alias("max_chunks"),
            F.round(F.sum("e") / total, 4).alias("empty_rate"),
            F.percentile("n", F.lit(0.5), weight).alias("median_chunks"),
            F.percentile("n", F.lit(0.95), weight).alias("p95_chunks"),
            F.max_by("role", F.when(F.col("t").isNotNull(), F.struct("t", "role"))).alias("largest_role"),
        )
        .withColumn("p95_chunks", F.rint("p95_chunks").cast("long"))
        .withColumn("finding", F.when(F.col("empty_rate") >= 0.40, "severe").when(F.col("empty_rate") >= 0.10, "notable").otherwise("none"))
        .withColumn(
            "advice",
            F.when(F.col("total_chunks") == 0, "corpus is empty")
            .when(F.col("empty_rate") >= 0.40, "retire chunker")
            .when(F.col("max_chunks") > 50, "raise chunk size")
            .otherwise("healthy"),
        )
    )
