"""Reading profile trees, JSON lines and requirement documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.functions.core import let

# Endings of files derived from a profile rather than being one.
DERIVED_SUFFIXES = ["_intelligence_report", "_structured_profile"]
BATCH_SUFFIXES = [*DERIVED_SUFFIXES, "_ranked"]
CORRUPT = "_corrupt_record"


def parse_profile_files(files: DataFrame, schema: T.StructType, suffixes: list[str] = DERIVED_SUFFIXES) -> DataFrame:
    """Profiles from whole file texts, with their role and path; unreadable ones keep their text as corrupt.

    ``files``: path, value. The role is the folder name; files whose name ends in a derived suffix are left out.
    """
    columns = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    derived = F.lit(False)
    for suffix in suffixes:
        derived = derived | F.endswith(stem, F.lit(suffix))
    return (
        files.filter((stem != "") & ~derived)
        .select(
            F.from_json("value", columns, {"columnNameOfCorruptRecord": CORRUPT}).alias("_p"),
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("role"),
            F.col("path").alias("source_file"),
        )
        .select("_p.*", "role", "source_file")
    )


def read_profile_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole texts of ``<root>/<role>/*.json``; a role is read alone by naming its folder."""
    files = spark.read.text(f"{root.rstrip('/')}/*/*.json", wholetext=True)
    return files.select(F.url_decode(F.col("_metadata.file_path")).alias("path"), "value")


def scan_profiles(files: DataFrame, schema: T.StructType, suffixes: list[str] = DERIVED_SUFFIXES) -> DataFrame:
    """Readable profiles."""
    return parse_profile_files(files, schema, suffixes).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def scan_rejects(files: DataFrame, schema: T.StructType, suffixes: list[str] = DERIVED_SUFFIXES) -> DataFrame:
    """Files per role that could not be read."""
    bad = parse_profile_files(files, schema, suffixes).filter(F.col(CORRUPT).isNotNull())
    return bad.groupBy("role").agg(F.count(F.lit(1)).alias("n_rejected"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per non-blank line; malformed lines keep their text in the corrupt column."""
    columns = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(columns).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The well-formed lines of a JSON lines file; a bad line never costs the others."""
    return read_jsonl(spark, path, schema).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


_JOB = "struct<job_title:string,title:string,company:string,start_date:string,end_date:string,dates:string,is_current:boolean,location:string,responsibilities:array<string>,tools_and_skills:array<string>,details:array<string>>"
_DEGREE = "struct<degree:string,field_of_study:string,major:string,institution:string,description:string>"
_SKILL = "struct<name_canonical:string,name_raw:string>"
_PROFILE = "struct<summary:string,experience:string,education:string,skills:string,projects:string,certifications:string,languages:string>"
_ROOT = f"candidate_id string, source_file string, candidate_profile {_PROFILE}, " + _PROFILE[7:-1].replace(":", " ").replace(",", ", ")


def normalize_layouts(raw: DataFrame) -> DataFrame:
    """Both profile layouts as one: summary text, job and degree entries, skills and lists of strings.

    ``raw``: raw_json. A nested ``candidate_profile`` wins over root fields. Entry lists may be flat or under
    ``entries``; skills may be names or structs; empty text and null are the same.
    """

    def entries(text: Column, item: str) -> Column:
        flat = F.from_json(text, f"array<{item}>")
        nested = F.from_json(text, f"struct<entries:array<{item}>>")["entries"]
        found = F.when(F.startswith(F.trim(text), F.lit("[")), flat).otherwise(nested)
        return F.coalesce(found, F.array().cast(f"array<{item}>"))

    def blank(text: Column) -> Column:
        return F.nullif(F.trim(text), F.lit(""))

    def job(e: Column) -> Column:
        end = F.coalesce(blank(e["end_date"]), F.when(e["is_current"], F.lit("Present")), F.lit(""))
        joined = F.regexp_replace(F.concat(F.coalesce(e["start_date"], F.lit("")), F.lit(" - "), end), r"^[ \-]+|[ \-]+$", "")
        no_list = F.array().cast("array<string>")
        return F.struct(
            F.coalesce(blank(e["job_title"]), blank(e["title"])).alias("title"),
            blank(e["company"]).alias("company"),
            F.coalesce(blank(e["dates"]), blank(joined)).alias("dates"),
            blank(e["location"]).alias("location"),
            F.concat(*[F.coalesce(e[c], no_list) for c in ("details", "responsibilities", "tools_and_skills")]).alias("details"),
        )

    def degree(e: Column) -> Column:
        parts = F.array(blank(e["degree"]), F.coalesce(blank(e["field_of_study"]), blank(e["major"])), blank(e["institution"]))
        return F.struct(F.coalesce(blank(e["description"]), blank(F.concat_ws(" | ", parts))).alias("description"))

    def names(text: Column) -> Column:
        plain = F.from_json(text, "array<string>")
        structs = F.from_json(text, f"array<{_SKILL}>")
        named = F.transform(structs, lambda s: F.coalesce(blank(s["name_canonical"]), blank(s["name_raw"])))
        is_struct = F.rlike(F.trim(text), F.lit(r"^\[\s*\{"))
        return F.filter(F.coalesce(F.when(is_struct, named).otherwise(plain), F.array().cast("array<string>")), lambda s: s.isNotNull())

    doc = raw.select(F.from_json("raw_json", _ROOT).alias("d"))

    def field(name: str) -> Column:
        return F.coalesce(blank(F.col(f"d.candidate_profile.{name}")), blank(F.col(f"d.{name}")))

    summary = field("summary")
    return doc.select(
        F.col("d.candidate_id").alias("candidate_id"),
        F.coalesce(blank(F.get_json_object(summary, "$.value")), F.when(~F.startswith(summary, F.lit("{")), summary)).alias("summary"),
        F.transform(entries(field("experience"), _JOB), job).alias("experience"),
        F.transform(entries(field("education"), _DEGREE), degree).alias("education"),
        names(field("skills")).alias("skills"),
        *[names(field(c)).alias(c) for c in ("projects", "certifications", "languages")],
    )



def _requirement_type(category: Column) -> Column:
    low = F.lower(category)
    return (
        F.when(F.rlike(low, F.lit("core|required")), "required")
        .when(F.rlike(low, F.lit("preferred|optional")), "preferred")
        .when(F.rlike(low, F.lit("experience|education")), "required")
        .when(F.contains(low, F.lit("certification")), "preferred")
        .otherwise("required")
    )


def requirement_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole requirement documents with their path. Feed the result to the two parsers below."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def _requirement_sections(docs: DataFrame) -> DataFrame:
    """One row per ``### REQ-n: name`` heading with the text up to the next one."""
    parts = F.split("text", r"(?=###\s+REQ-\d+:\s)")
    head = r"^###\s+(REQ-\d+):\s+([^\n]+)"
    return (
        docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(parts).alias("pos", "_part"))
        .filter(F.rlike("_part", F.lit(head)))
        .withColumn("req_id", F.regexp_extract("_part", head, 1))
        .withColumn("req_name", F.trim(F.regexp_extract("_part", head, 2)))
        .withColumn("body", F.regexp_replace("_part", head + r"\n?", ""))
        .drop("_part")
    )


def markdown_requirements(docs: DataFrame) -> DataFrame:
    """Requirements of the documents. ``docs``: text and any key columns.

    Category, description, sub-query count and formula come from their marked lines; without a description the
    first three plain lines before the next mark are used.
    """

    def plain(body: Column) -> Column:
        lines = F.transform(F.split(F.trim(body), "\n"), lambda x: F.trim(x))
        marks = F.transform(lines, lambda x: F.startswith(x, F.lit("**")))
        first = F.coalesce(F.nullif(F.array_position(marks, F.lit(True)), F.lit(0)).cast("int"), F.size(lines) + 1)
        before = F.filter(F.slice(lines, F.lit(1), first - 1), lambda x: (x != "") & ~F.startswith(x, F.lit("|")))
        return F.array_join(F.slice(before, 1, 3), " ")

    category = F.coalesce(F.nullif(F.trim(F.regexp_extract("body", r"\*\*Category:\*\*[ \t]*([^\n]+)", 1)), F.lit("")), F.lit("Unknown"))
    marked = F.regexp_extract("body", r"(?s)\*\*(?:Description|Purpose):\*\*\s*(.+?)(?:\n\n|\n\*\*|\z)", 1)
    return _requirement_sections(docs).select(
        *[c for c in docs.columns if c != "text"], "pos", "req_id", "req_name",
        category.alias("category"),
        _requirement_type(category).alias("req_type"),
        F.when(marked != "", F.trim(marked)).otherwise(let(F.col("body"), plain)).alias("description"),
        F.coalesce(
            F.nullif(F.regexp_extract("body", r"\*\*Sub-Query Count:\*\*\s*(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1)
        ).alias("subquery_count"),
        F.trim(F.regexp_extract("body", r"\*\*Scoring Formula:\*\*\s*([^\n]+)", 1)).alias("scoring_formula"),
    )


def markdown_sub_queries(docs: DataFrame) -> DataFrame:
    """Sub-query rows of the requirement tables: ``| SQnn | text | type | scale | method |``.

    Rows with fewer than five cells drop out; further cells belong to the method and are joined back.
    """
    lines = _requirement_sections(docs).select(
        *[c for c in docs.columns if c != "text"], "pos", "req_id", F.posexplode(F.split("body", "\n")).alias("line_no", "_line")
    )
    cells = F.transform(F.split(F.regexp_replace(F.trim("_line"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    return (
        lines.filter(F.rlike("_line", F.lit(r"^\|\s*SQ\d+\s*\|")))
        .withColumn("_c", cells)
        .filter(F.size("_c") >= 5)
        .select(
            *[c for c in docs.columns if c != "text"], "pos", "req_id", "line_no",
            *[F.col("_c")[i].alias(n) for i, n in enumerate(("sq_key", "sq_text", "sq_type", "scale"))],
            F.array_join(F.slice("_c", F.lit(5), F.size("_c") - 4), "|").alias("method"),
        )
    )
