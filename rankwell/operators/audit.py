"""Data-quality audit of extracted profiles: rules, dimension scores, status and queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.functions.bands import has_any
from rankwell.functions.core import let
from rankwell.functions.text import strip

# What a profile must hold, what its text may show, and how the dimensions weigh.
TOP_KEYS = [
    "schema_version", "candidate_id", "candidate_profile", "evidence_chunks", "field_evidence_map", "validation",
    "confidence", "raw",
]
PROFILE_FIELDS = {
    "full_name": ["STRING"], "headline": ["STRING"], "summary": ["STRING", "OBJECT"], "skills": ["ARRAY"],
    "education": ["ARRAY", "OBJECT"], "experience": ["ARRAY", "OBJECT"], "projects": ["ARRAY"],
    "certifications": ["ARRAY"], "languages": ["ARRAY"], "emails": ["ARRAY"], "phones": ["ARRAY"], "links": ["OBJECT"],
}
EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
PHONE = r"(?:\+?\d{1,4}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"
LINKS = r"linkedin\.com/[a-zA-Z0-9_\-/]+|github\.com/[a-zA-Z0-9_\-/]+"
DATE_SPAN = (
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}\b"
    r"|\b\d{4}\b\s*-\s*(?:\b\d{4}\b|Present|present|Current|current)"
)
EDUCATION_HEADING = r"(?i)\b(?:education|academic|background|studies)\b"
EXPERIENCE_HEADING = r"(?i)\b(?:experience|employment|work history|career|history)\b"
SKILL_HEADING = r"(?i)\b(?:skills|technical skills|expertise|technologies|proficiencies)\b"
EDUCATION_WORDS = [
    "bachelor", "master", "phd", "b.sc", "m.sc", "b.tech", "m.tech", "degree", "university", "college", "institute",
]
CERTIFICATE_WORDS = [
    "certified", "certification", "aws", "azure", "gcp", "pmp", "scrum", "oracle", "cisco", "ccna",
]
KEY_SECTIONS = ["experience", "education", "certifications", "projects", "skills"]
EVIDENCE_WORDS = [
    "certified", "certification", "aws", "azure", "gcp", "pmp", "scrum", "bachelor", "master", "phd", "degree",
    "university", "college", "developed", "managed", "designed", "engineered", "implemented",
]
DIMENSION_WEIGHTS = {
    "schema_score": 0.20, "field_score": 0.25, "section_score": 0.20, "evidence_score": 0.20,
    "agreement_score": 0.10, "ocr_score": 0.05,
}
NOTHING = ["", "none", "null", "n/a"]


def _check(condition: Column, check_id, severity: str, layer: str, field) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(
        condition,
        F.struct(
            as_col(check_id).alias("check_id"), F.lit(severity).alias("severity"),
            F.lit(layer).alias("layer"), as_col(field).alias("field"),
        ),
    )


def _failed(checks: list[Column]) -> Column:
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def _get(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def _entries(profile: Column, name: str) -> Column:
    value = _get(profile, f"$.{name}")
    plain = F.try_variant_get(value, "$", "array<variant>")
    nested = F.try_variant_get(value, "$.entries", "array<variant>")
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.when(_kind(value) == "ARRAY", plain), F.when(_kind(value) == "OBJECT", nested), empty)


def _date_ok(value: Column) -> Column:
    """A missing or empty date passes; anything else must be YYYY or YYYY-MM text."""
    text = F.try_variant_get(value, "$", "string")
    blank = value.isNull() | F.is_variant_null(value) | (text == "")
    return blank | ((_kind(value) == "STRING") & F.rlike(strip(text), F.lit(r"^\d{4}(-\d{2})?$")))


def _field_check(profile: Column, name: str, kinds: list[str]) -> Column:
    where = f"candidate_profile.{name}"

    def check(x: Column) -> Column:
        wrong = ~F.is_variant_null(x["v"]) & ~_kind(x["v"]).isin(kinds)
        return F.coalesce(
            _check(x["v"].isNull(), f"schema_field_missing_{name}", "error", "schema", where),
            _check(wrong, f"schema_field_type_invalid_{name}", "error", "schema", where),
        )

    return let(F.struct(_get(profile, f"$.{name}").alias("v")), check)


def audit_schema(raw: DataFrame) -> DataFrame:
    """Schema findings and score per candidate. ``raw``: candidate_id, raw_json.

    Score = 1 - errors / checks, 0 without a profile object. Findings stay in an array whose length the
    profile's own entries bound; :func:`explode_checks` makes rows of them.
    """
    doc = raw.withColumn("_doc", F.try_parse_json("raw_json")).withColumn("_p", _get(F.col("_doc"), "$.candidate_profile"))
    top = [_check(_get(F.col("_doc"), f"$.{k}").isNull(), "schema_top_key_missing", "critical", "schema", k) for k in TOP_KEYS]
    no_object = _check(
        F.col("_p").isNotNull() & (_kind(F.col("_p")) != "OBJECT"),
        "schema_profile_not_dict", "critical", "schema", "candidate_profile",
    )
    fields = []
    for name, kinds in PROFILE_FIELDS.items():
        fields.append(_field_check(F.col("_p"), name, kinds))

    def per_entry(name: str, short: str, with_current: bool) -> tuple[Column, Column]:
        entries = _entries(F.col("_p"), name)
        per = 3 if with_current else 2

        def rules(e: Column, i: Column) -> Column:
            n = i.cast("string")
            is_object = _kind(e) == "OBJECT"
            end = _get(e, "$.end_date")
            end_text = F.lower(F.trim(F.coalesce(F.try_variant_get(e, "$.end_date", "string"), F.lit(""))))
            current = F.coalesce(F.try_variant_get(e, "$.is_current", "boolean"), F.lit(False))
            where = F.concat(F.lit(f"candidate_profile.{name}["), n, F.lit("]"))
            checks = [
                _check(~is_object, F.concat(F.lit(f"schema_{short}_not_dict_"), n), "error", "schema", where),
                _check(is_object & ~_date_ok(_get(e, "$.start_date")), F.concat(F.lit(f"schema_{short}_start_date_format_"), n), "error", "schema", where),
                _check(is_object & ~_date_ok(end), F.concat(F.lit(f"schema_{short}_end_date_format_"), n), "error", "schema", where),
            ]
            if with_current:
                open_end = end_text.isin("null", "none", "")
                checks.append(_check(is_object & open_end & ~current, F.concat(F.lit(f"schema_{short}_current_mismatch_"), n), "warning", "schema", where))
            return _failed(checks)

        found = F.flatten(F.transform(entries, rules))
        total = F.aggregate(entries, F.lit(0), lambda s, e: s + F.when(_kind(e) == "OBJECT", per).otherwise(0))
        return found, total

    jobs, n_jobs = per_entry("experience", "exp", True)
    degrees, n_degrees = per_entry("education", "edu", False)
    skills = F.when(_kind(_get(F.col("_p"), "$.skills")) == "ARRAY", F.try_variant_get(F.col("_p"), "$.skills", "array<variant>"))
    skills = F.coalesce(skills, F.array().cast("array<variant>"))

    def skill_name(s: Column) -> Column:
        named = F.coalesce(
            F.nullif(F.try_variant_get(s, "$.name_raw", "string"), F.lit("")), F.try_variant_get(s, "$.name_canonical", "string")
        )
        return F.when(_kind(s) == "OBJECT", named).when(_kind(s) == "STRING", F.try_variant_get(s, "$", "string"))

    nameless = F.flatten(F.transform(
        skills,
        lambda s, i: _failed([_check(
            F.trim(F.coalesce(skill_name(s), F.lit(""))) == "",
            F.concat(F.lit("schema_skill_name_invalid_"), i.cast("string")), "error", "schema", "candidate_profile.skills",
        )]),
    ))
    confidence = _get(F.col("_doc"), "$.confidence")
    number = F.try_variant_get(F.col("_doc"), "$.confidence.document_confidence", "double")
    given = _get(F.col("_doc"), "$.confidence.document_confidence")
    has_confidence = F.coalesce(_kind(confidence) == "OBJECT", F.lit(False))
    confidence_checks = _failed([
        _check(has_confidence & ~number.between(0.0, 1.0), "schema_doc_confidence_out_of_bounds", "error", "schema", "confidence.document_confidence"),
        _check(
            has_confidence & given.isNotNull() & ~F.is_variant_null(given) & number.isNull(),
            "schema_doc_confidence_not_float", "error", "schema", "confidence.document_confidence",
        ),
    ])
    usable = F.coalesce(_kind(F.col("_p")) == "OBJECT", F.lit(False))
    total = len(TOP_KEYS) + len(PROFILE_FIELDS) + n_jobs + n_degrees + F.size(skills) + F.when(has_confidence, 1).otherwise(0)
    deep = F.concat(_failed(fields), jobs, degrees, nameless, confidence_checks)
    return (
        doc.withColumn("_usable", usable)
        .withColumn("checks", F.when(F.col("_usable"), F.concat(_failed(top), deep)).otherwise(_failed([*top, no_object])))
        .withColumn("n_checks", F.when(F.col("_usable"), total).otherwise(F.lit(len(TOP_KEYS))))
        .withColumn(
            "score",
            F.when(F.col("_usable"), F.greatest(F.lit(0.0), 1 - F.size("checks") / F.col("n_checks"))).otherwise(0.0),
        )
        .drop("_doc", "_p", "_usable", "raw_json")
    )


def audit_completeness(profiles: DataFrame) -> DataFrame:
    """Seven checks of the raw text against what was extracted; score = 1 - failed / 7.

    ``profiles``: candidate_id, raw_text and the extracted counts n_emails, n_phones, n_links, n_experience,
    n_education, n_certifications, n_skills.
    """

    def empty(n: str) -> Column:
        return F.col(n) == 0

    def findings(text: Column) -> Column:
        def seen(pattern: str) -> Column:
            return F.rlike(text, F.lit(pattern))

        spans = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(DATE_SPAN), F.lit(0))))
        facts = F.struct(
            F.lower(text).alias("low"),
            (empty("n_experience") & seen(EXPERIENCE_HEADING)).alias("jobs"),
            (empty("n_education") & seen(EDUCATION_HEADING)).alias("degrees"),
            F.when(F.contains(text, F.lit("20")) | F.contains(text, F.lit("19")) | seen(r"\d{4}"), spans).otherwise(0).alias("spans"),
        )

        # Each condition starts with what is cheap and usually false; And stops there.
        def checks(f: Column) -> Column:
            few_jobs = (f["spans"] > 2) & (F.col("n_experience") <= F.floor(f["spans"] / 2))
            return _failed([
                _check(empty("n_emails") & F.contains(text, F.lit("@")) & seen(EMAIL), "completeness_email_missing", "warning", "field", "emails"),
                _check(empty("n_phones") & seen(PHONE), "completeness_phone_missing", "warning", "field", "phones"),
                _check(empty("n_links") & F.contains(text, F.lit(".com/")) & seen(LINKS), "completeness_links_missing", "warning", "field", "links"),
                _check(f["jobs"], "completeness_exp_section_empty", "error", "section", "experience"),
                _check(~f["jobs"] & few_jobs, "completeness_exp_count_low", "warning", "section", "experience"),
                _check(f["degrees"], "completeness_edu_section_empty", "error", "section", "education"),
                _check(
                    empty("n_education") & ~f["degrees"] & has_any(f["low"], EDUCATION_WORDS),
                    "completeness_edu_missing_heuristic", "warning", "field", "education",
                ),
                _check(
                    empty("n_certifications") & has_any(f["low"], CERTIFICATE_WORDS),
                    "completeness_certs_missing_heuristic", "warning", "field", "certifications",
                ),
                _check(empty("n_skills") & seen(SKILL_HEADING), "completeness_skills_section_empty", "warning", "section", "skills"),
            ])

        return let(facts, checks)

    collapsed = F.trim(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"\s+", " "))
    return profiles.select("candidate_id", let(collapsed, findings).alias("checks")).select(
        "candidate_id", "checks",
        (1 - F.size("checks") / 7).alias("score"),
        F.greatest(
            F.lit(0.0), 1 - F.size(F.filter("checks", lambda c: c["layer"] == "section")) / 3.0
        ).alias("section_score"),
    )


def explode_checks(audited: DataFrame) -> DataFrame:
    return audited.select("candidate_id", F.explode("checks").alias("_c")).select("candidate_id", "_c.*")


def evidence_checks(evidence_map: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings of the evidence audit, one row each with its ``penalty``; sound references have none.

    ``evidence_map``: candidate_id, field, chunk_id; ``chunks``: candidate_id, chunk_id, section, text. Mapped
    ids must exist and hold text (1 each), repeated ids counting once; an unmapped chunk in a key section, or of more than 30 characters
    with a key word, costs 0.5.
    """
    keys = ["candidate_id", "chunk_id"]
    known = chunks.groupBy(*keys).agg(F.bool_or(strip(F.coalesce("text", F.lit(""))) != "").alias("_text"))
    forward = evidence_map.join(known, keys, "left").select(
        *keys, "field",
        F.when(F.col("_text").isNull(), "evidence_missing_chunk_id").when(~F.col("_text"), "evidence_empty_chunk_text").alias("check_id"),
    ).withColumn("penalty", F.when(F.col("check_id").isNotNull(), 1.0).otherwise(0.0))
    low = F.lower(F.coalesce("text", F.lit("")))
    meaningful = has_any(F.lower(F.coalesce("section", F.lit(""))), KEY_SECTIONS) | (
        has_any(low, EVIDENCE_WORDS) & (F.length(strip(F.coalesce("text", F.lit("")))) > 30)
    )
    reverse = (
        chunks.join(evidence_map.select(*keys).distinct(), keys, "left_anti")
        .filter(meaningful)
        .select(*keys, F.lit("evidence_chunks").alias("field"), F.lit("evidence_unmapped_chunk").alias("check_id"), F.lit(0.5).alias("penalty"))
    )
    return forward.unionByName(reverse)


def audit_evidence(candidates: DataFrame, evidence_map: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence coverage per candidate: 1 - penalties / checks, not below 0; 1 without checks."""
    sums = evidence_checks(evidence_map, chunks).groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("penalty").alias("_e")
    )
    return candidates.select("candidate_id").join(sums, "candidate_id", "left").select(
        "candidate_id",
        F.coalesce("_n", F.lit(0)).alias("n_checks"),
        F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("_e") / F.col("_n")), F.lit(1.0)).alias("score"),
    )


def audit_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Agreement of two extractions: close names, equal e-mail sets, entry counts within one; share of four.

    Both: candidate_id, full_name, emails, n_experience, n_education.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("candidate_id", *[F.col(c).alias(f"{c}_{s}") for c in ("full_name", "emails", "n_experience", "n_education")])

    def emails(c: str) -> Column:
        clean = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda e: F.lower(F.trim(e)))
        return F.array_sort(F.array_distinct(F.filter(clean, lambda e: e != "")))

    a, b = F.coalesce("full_name_a", F.lit("")), F.coalesce("full_name_b", F.lit(""))
    agree = [
        F.when((a != "") & (b != ""), F.levenshtein(a, b) <= 2).otherwise((a == "") & (b == "")).alias("name_agrees"),
        (emails("emails_a") == emails("emails_b")).alias("emails_agree"),
        (F.abs(F.col("n_experience_a") - F.col("n_experience_b")) <= 1).alias("experience_agrees"),
        (F.abs(F.col("n_education_a") - F.col("n_education_b")) <= 1).alias("education_agrees"),
    ]
    names = ["name_agrees", "emails_agree", "experience_agrees", "education_agrees"]
    points = reduce(lambda x, y: x + y, (F.col(n).cast("int") for n in names))
    return side(first, "a").join(side(second, "b"), "candidate_id").select("candidate_id", *agree).withColumn("score", points / 4)


def ocr_score(ocr_text: Column, document_confidence: Column, field_confidence: Column) -> Column:
    """1 without OCR text; else the document's confidence, else the mean field confidence, else 1."""
    values = F.map_values(field_confidence)
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values))
    used = F.trim(F.coalesce(ocr_text, F.lit(""))) != ""
    return F.when(used, F.coalesce(document_confidence, mean, F.lit(1.0))).otherwise(1.0)


def score_status(scores: DataFrame) -> DataFrame:
    """Weighted quality and status. ``scores``: the six dimension scores and has_critical."""
    weighted = reduce(lambda a, b: a + b, (F.col(c) * w for c, w in DIMENSION_WEIGHTS.items()))
    overall = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted))
    return scores.withColumn("overall", overall).withColumn(
        "status",
        F.when(F.col("overall") < 0.65, "failed")
        .when(F.col("has_critical") | (F.col("overall") < 0.85), "review_required")
        .otherwise("passed"),
    )


def review_triggers(checks: DataFrame) -> DataFrame:
    return checks.filter(
        F.col("severity").isin("critical", "error")
        | ((F.col("severity") == "warning") & F.col("layer").isin("section", "schema"))
    )


def audit_rollup(statuses: DataFrame) -> DataFrame:
    """Counts, share passed and mean quality per role; the null role is the whole corpus."""
    n = F.count(F.lit(1))
    return statuses.rollup("role").agg(
        n.alias("n"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("passed", "review_required", "failed")],
        (100.0 * F.count_if(F.col("status") == "passed") / n).alias("pct_passed"),
        F.avg("overall").alias("mean_overall"),
    )


def severity_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("candidate_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "error", "warning")]
    )


def review_queue(statuses: DataFrame, checks: DataFrame) -> DataFrame:
    """Issues of failed, then of review candidates, worst quality first; one row per issue."""
    queued = statuses.filter(F.col("status") != "passed").select("role", "candidate_id", "status", "overall")
    issues = checks.filter(F.col("severity").isin("critical", "error", "warning"))
    return queued.join(issues, "candidate_id", "left").orderBy(
        F.when(F.col("status") == "failed", 0).otherwise(1), "overall", "candidate_id", "check_id"
    )


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Validity, missing fields, warnings and mean confidence.

    ``profiles``: candidate_id, full_name, emails, phones, and skills, education, experience, certifications as
    array<struct<confidence double>>.
    """

    def empty(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    no_name = F.coalesce("full_name", F.lit("")) == ""
    missing = F.filter(
        F.array(F.when(no_name, F.lit("candidate_profile.full_name")), F.when(empty("emails"), F.lit("candidate_profile.emails"))),
        lambda x: x.isNotNull(),
    )
    warnings = F.filter(
        F.array(*[F.when(empty(c), F.lit(c)) for c in ("phones", "skills", "education", "experience")]), lambda x: x.isNotNull()
    )
    no_values = F.array().cast("array<double>")
    values = F.filter(
        F.flatten(F.array(*[
            F.coalesce(F.transform(c, lambda x: x["confidence"]), no_values)
            for c in ("skills", "education", "experience", "certifications")
        ])),
        lambda v: v.isNotNull(),
    )
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values))
    return profiles.select(
        "candidate_id", missing.alias("missing_fields"), warnings.alias("warnings"),
        (F.size(missing) == 0).alias("is_valid"),
        F.coalesce(mean, F.when(no_name, 0.50).otherwise(0.90)).alias("confidence"),
    )


GAP_FIELDS = ["skills", "experience", "education", "certifications"]


def find_gaps(profiles: DataFrame) -> DataFrame:
    """Candidates with empty key lists; a missing profile lacks all four. ``profiles``: has_profile and the lists."""
    gaps = F.filter(
        F.array(*[
            F.when(~F.col("has_profile") | (F.coalesce(F.size(c), F.lit(0)) <= 0), F.lit(c)) for c in GAP_FIELDS
        ]),
        lambda g: g.isNotNull(),
    )
    return profiles.select("candidate_id", gaps.alias("gaps")).filter(F.size("gaps") > 0)


def below_quality(statuses: DataFrame, threshold: float) -> DataFrame:
    return statuses.filter(F.col("overall") < threshold).select("candidate_id").distinct()


SCALARS = ["full_name", "headline", "summary"]
LISTS = ["skills", "education", "experience", "projects", "certifications", "languages"]
LINK_KEYS = ["linkedin", "github", "portfolio", "other"]


def gap_fill(profiles: DataFrame, patches: DataFrame) -> DataFrame:
    """Fills only what is missing from a second extraction and lists the fields changed.

    Both: candidate_id, the scalars (string), the lists (arrays) and links (map<string,string>). Values such as
    ``none`` or ``n/a`` count as missing. Recompute tenure and highest degree from the result.
    """

    def absent(c: Column) -> Column:
        return c.isNull() | F.lower(F.trim(c)).isin(NOTHING)

    def hollow(c: Column) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    rows = profiles.alias("p").join(patches.alias("g"), "candidate_id", "left")
    p, g = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"g.{c}"))
    fill = {c: absent(p(c)) & ~absent(g(c)) for c in SCALARS}
    fill |= {c: hollow(p(c)) & ~hollow(g(c)) for c in LISTS}

    def link(side, k: str) -> Column:
        return F.coalesce(F.try_element_at(side("links"), F.lit(k)), F.lit(""))

    new_links = {k: (link(p, k) == "") & (link(g, k) != "") for k in LINK_KEYS}
    kept = F.map_filter(
        F.coalesce(p("links"), F.create_map().cast("map<string,string>")),
        lambda k, v: ~reduce(lambda a, b: a | b, ((k == F.lit(n)) & new_links[n] for n in LINK_KEYS)),
    )
    added = F.map_filter(
        F.coalesce(g("links"), F.create_map().cast("map<string,string>")),
        lambda k, v: reduce(lambda a, b: a | b, ((k == F.lit(n)) & new_links[n] for n in LINK_KEYS)),
    )
    changed = F.filter(
        F.array(
            *[F.when(cond, F.lit(c)) for c, cond in fill.items()],
            *[F.when(cond, F.lit(f"links.{k}")) for k, cond in new_links.items()],
        ),
        lambda c: c.isNotNull(),
    )
    return rows.select(
        "candidate_id",
        *[F.when(cond, g(c)).otherwise(p(c)).alias(c) for c, cond in fill.items()],
        F.map_concat(kept, added).alias("links"),
        changed.alias("changed"),
    )
