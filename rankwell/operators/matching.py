"""Requirements against profile text: aliases, tiers, degrees, locations, sections and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions import matching as M
from rankwell.functions.bands import binary_score, grade_band, has_any, tier_band
from rankwell.operators.ranking import top_rows
from rankwell.runtime import durable, small_side, tasks_for

# Other words for a requirement. Entries holding \b are patterns, all others literal phrases.
SYNONYMS = {
    "power bi": ["powerbi", "pbi", "dax", "power query"],
    "sql": ["mysql", "postgresql", "postgres", "t-sql", "tsql", "pl/sql", "bigquery", "sql server"],
    "excel": ["vlookup", "pivot table", "pivottables", "spreadsheet", "microsoft excel"],
    "agile tools": ["jira", "azure devops", "ado", "confluence", "trello", "asana", "scrum", "kanban", "sprint"],
    "requirements gathering": [
        "requirement gathering", "requirement elicitation", "elicit requirement", "gather requirement", "user story",
        "user stories", "acceptance criteria", "functional spec", "functional specification", "business requirement",
    ],
    "stakeholder management": [
        "stakeholder", "stakeholders", "cross-functional", "cross functional", "liaison", "business partner",
        "client engagement",
    ],
    "process mapping": [
        "process map", "process mapping", "process improvement", "business process", "process re-engineering",
        "process redesign", "process optimization", "process analysis", "as-is", "to-be", "processes",
    ],
    "data analysis": [
        "data analysis", "data analytics", "data driven", "data-driven", "analyze data", "analyse data",
        "analyzed data", "analysed data", "analyze", "analyse", "analyzed", "analysed", "analysis", "analytical",
        "insight", "kpi", "metrics", "trend analysis", "reporting", "dashboard", "business data",
    ],
    "communication": [
        "communication", "communicate", "presented", "presentation", "stakeholder communication", "status update",
        "executive summary", "documentation", "report",
    ],
    "cbap / pmi-pba": ["cbap", "pmi-pba", "pmi pba", "certified business analysis professional"],
    "bi / analytics certification": [
        "power bi certification", "tableau certification", "analytics certification", "bi certification",
    ],
    "be/btech or equivalent": [
        r"\bb\.?\s?tech\b", r"\bbtech\b", r"\bbachelor of engineering\b", r"\bbachelor of technology\b",
        r"\bbachelor in engineering\b", r"\bundergraduate degree\b", r"\bbachelor of arts\b", r"\bbsc\b", r"\bb\.?sc\b",
    ],
    "6+ years in business analysis": [r"\bbusiness analyst\b", r"\bbusiness analysis\b", r"\bba role\b", r"\bba\b"],
    "industry/domain experience": [
        "e-commerce", "ecommerce", "retail", "fintech", "banking", "healthcare", "saas", "manufacturing",
    ],
    "agile": [
        "agile software development", "agile methodology", "agile environment", "scrum master", "scrum team",
        "sprint planning", "agile delivery", "wrike", "attask", "monday.com", "smartsheet",
    ],
}
# Tokens a pattern's match can begin with, where that is not simply its first word.
PATTERN_STARTS = {r"\bb\.?\s?tech\b": ["b", "btech"], r"\bb\.?sc\b": ["b", "bsc"]}
QUESTION_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "has", "have", "what", "how", "when", "where", "who", "why", "does",
    "do", "their", "this", "that", "with", "for", "and", "or", "in", "of", "to", "on", "at", "can", "did", "they",
]
MAX_FULL_CHARS = 6000
SEPARATOR = "\n\n---\n\n"


def alias_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every distinct ``name`` with each alias row that occurs in it as a whole word.

    Repeated names are looked up once. A whole-word alias shares its first token with the text, so names and
    aliases meet in an equi-join on that token and the boundary test runs on those candidates alone.
    """
    usable = aliases.filter(F.col("alias") != "_default_").withColumn("_t", M.first_token(F.col("alias")))
    found = names.select("name").distinct().withColumn("_t", F.explode(M.tokens(F.col("name"))))
    return found.join(small_side(usable), "_t").filter(M.whole_word(F.lower(F.trim("name")), F.lower("alias"))).drop("_t")


def tier_lookup(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds tier and points of ``name``: best tier, then first entry; unlisted 0.01, empty or null 0.

    ``aliases``: tier (tier_1..tier_3), points, entry_pos, alias, note.
    """
    best = alias_matches(names, aliases).groupBy("name").agg(
        F.min_by(F.struct("tier", "points"), F.struct("tier", "entry_pos")).alias("_b")
    )
    empty = F.coalesce(F.trim("name"), F.lit("")) == ""
    return names.join(best, "name", "left").select(
        *names.columns,
        F.col("_b.tier").alias("tier"),
        F.when(empty, 0.0).otherwise(F.coalesce(F.col("_b.points"), F.lit(0.01))).alias("points"),
    )


def flagged_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows whose name matches an alias of an entry that carries a note."""
    noted = aliases.filter(F.col("note").isNotNull())
    return names.join(alias_matches(names, noted).select("name").distinct(), "name", "left_semi")


def flagged_entries(aliases: DataFrame) -> DataFrame:
    return aliases.filter(F.col("note").isNotNull()).select("tier", "entry_pos", "note").distinct()


def degree_match(degrees: DataFrame, reqs: DataFrame) -> DataFrame:
    """Per candidate and education requirement: does any degree satisfy it, and which first.

    ``degrees``: role, candidate_id, pos, degree, institution; ``reqs``: role, req_id, req_name. Each distinct
    degree text of a role meets each requirement name once; candidates are then looked up, in as many tasks as their
    degrees times requirements need.
    """
    held = durable(degrees.groupBy("role", "degree").agg(F.count(F.lit(1)).alias("_n")))
    asked = reqs.groupBy("role").agg(F.count(F.lit(1)).alias("_m"))
    rows = held.join(asked, "role").agg(F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0))).first()[0]
    texts = held.drop("_n").join(reqs.select("role", "req_name").distinct(), "role")
    direct = M.phrase_match(F.col("req_name"), F.col("degree")) | M.phrase_match(F.col("degree"), F.col("req_name"))
    generic = has_any(F.lower("req_name"), M.GENERIC_DEGREE)
    verdicts = texts.select("role", "degree", "req_name", direct.alias("_direct"), generic.alias("_generic"))
    return (
        degrees.repartition(tasks_for(degrees.sparkSession, rows), "role", "candidate_id")
        .join(small_side(verdicts), ["role", "degree"])
        .join(small_side(reqs.select("role", "req_id", "req_name")), ["role", "req_name"])
        .groupBy("role", "candidate_id", "req_id")
        .agg(
            (F.max("_direct") | F.max("_generic")).alias("matched"),
            F.min_by(F.struct("degree", "institution"), F.struct(~F.col("_direct"), F.col("pos"))).alias("_d"),
        )
        .select(
            "role", "candidate_id", "req_id", "matched",
            F.when(F.col("matched"), F.col("_d.degree")).alias("degree"),
            F.when(F.col("matched"), F.col("_d.institution")).alias("institution"),
        )
    )


def certificate_match(certs: DataFrame, reqs: DataFrame) -> DataFrame:
    """Candidates and requirements with a certificate whose name the requirement matches."""
    texts = certs.select("role", "cert").distinct().join(reqs.select("role", "req_name").distinct(), "role")
    hits = texts.filter(M.phrase_match(F.col("req_name"), F.col("cert")))
    return (
        certs.join(small_side(hits), ["role", "cert"])
        .join(small_side(reqs.select("role", "req_id", "req_name")), ["role", "req_name"])
        .select("role", "candidate_id", "req_id")
        .distinct()
    )


def location_match(candidates: DataFrame, reqs: DataFrame) -> DataFrame:
    """Whether the location named by a requirement occurs in the candidate's raw text.

    ``candidates``: role, candidate_id, raw_text; ``reqs``: role, req_id, req_name.
    """
    terms = reqs.select("role", "req_id", M.location_term(F.col("req_name")).alias("term"))
    return candidates.join(small_side(terms), "role").select(
        "role", "candidate_id", "req_id", "term",
        ((F.col("term") != "") & F.contains(F.lower("raw_text"), F.col("term"))).alias("matched"),
    )


def route_sections(reqs: DataFrame) -> DataFrame:
    """Requirement type and one row per section to read. ``reqs``: req_id, req_name, category."""
    return reqs.withColumn("req_type", M.requirement_type(F.col("category"), F.col("req_name"))).withColumn(
        "section", F.explode(M.sections_of(F.col("req_type")))
    )


def section_evidence(chunks: DataFrame, reqs: DataFrame, max_chars: int = MAX_FULL_CHARS) -> DataFrame:
    """Chunks of the routed sections per candidate and requirement.

    ``chunks``: role, candidate_id, chunk_id, pos, section, text, skills_asserted; ``reqs``: role, req_id,
    req_name, category. Above ``max_chars`` a skill requirement keeps only the chunks asserting the skill, when
    there are some and fewer than all. Rows keep the chunks; :func:`evidence_text` joins them.
    """
    routed = route_sections(reqs).withColumn("_s", F.lower("section")).drop("section", "category")
    rows = chunks.withColumn("_s", F.lower("section")).join(small_side(routed), ["role", "_s"]).drop("_s")
    skilled = (F.col("req_type") == "skill") & F.exists(
        "skills_asserted", lambda s: F.lower(s) == F.lower(F.col("req_name"))
    )
    rows = rows.withColumn("_skilled", F.coalesce(skilled, F.lit(False)))
    totals = rows.groupBy("role", "candidate_id", "req_id").agg(
        F.sum(F.length("text")).alias("total_chars"),
        F.count(F.lit(1)).alias("_all"),
        F.count_if("_skilled").alias("_n"),
    )
    narrow = (F.col("total_chars") > max_chars) & (F.col("_n") > 0) & (F.col("_n") < F.col("_all"))
    return (
        rows.join(totals, ["role", "candidate_id", "req_id"])
        .withColumn("filtered_by_skill", narrow)
        .filter(~narrow | F.col("_skilled"))
        .select("role", "candidate_id", "req_id", "req_type", "chunk_id", "pos", "text", "total_chars", "filtered_by_skill")
    )


def evidence_text(evidence: DataFrame, part_chars: int = 1 << 20) -> DataFrame:
    """Evidence of a candidate and requirement as text, in chunk order, in numbered parts.

    Columns: role, candidate_id, req_id, part_no, n_chunks, text. A chunk goes to the part in which it starts, so a part
    holds little more than ``part_chars`` and the parts put together are the whole text, separators included.
    """
    keys = ["role", "candidate_id", "req_id"]
    order = Window.partitionBy(*keys).orderBy("pos", "chunk_id")
    before = F.coalesce(F.sum(F.length("text") + len(SEPARATOR)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    piece = F.when(before > 0, F.concat(F.lit(SEPARATOR), F.col("text"))).otherwise(F.col("text"))
    parts = evidence.select(*keys, "pos", "chunk_id", piece.alias("_t"), F.floor(before / part_chars).cast("int").alias("_at"))
    joined = parts.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "_t"))).alias("_x"))
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy("_at")) - 1
    return joined.select(*keys, numbered.alias("part_no"), "n_chunks", F.array_join(F.transform("_x", lambda x: x["_t"]), "").alias("text"))


def keyword_topk(questions: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """Chunks of the asked candidate with most of the question's words, earlier chunks first on a tie.

    ``questions``: question_id, candidate_id, question; ``chunks``: candidate_id, pos, text.
    """
    asked = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"(?U)\w+"), F.lit(0)))
    wanted = questions.select(
        "question_id", "candidate_id",
        F.array_except(asked, F.array(*[F.lit(w) for w in QUESTION_STOP_WORDS])).alias("_w"),
    )
    low = F.lower("text")
    scored = wanted.join(chunks, "candidate_id").withColumn(
        "n_words", F.size(F.filter("_w", lambda w: F.contains(low, w)))
    )
    return top_rows(scored.drop("_w"), ["question_id"], [F.col("n_words").desc(), F.col("pos")], n)


def requirement_aliases(reqs: DataFrame, synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """One row per requirement and alias: alias_no, the pattern to find and a token its match begins with.

    A requirement takes the synonyms of every key contained in its name or containing it.
    """
    table = F.array(*[
        F.struct(F.lit(k).alias("key"), F.array(*[F.lit(v) for v in values]).alias("values"))
        for k, values in synonyms.items()
    ])
    name = M.squash(F.col("req_name"))
    related = F.filter(table, lambda s: F.contains(name, s["key"]) | F.contains(s["key"], name))
    every = F.array_distinct(F.concat(F.array(name), F.flatten(F.transform(related, lambda s: s["values"]))))
    rows = reqs.select("*", F.posexplode(every).alias("alias_no", "_a")).filter(F.col("_a") != "")
    is_pattern = F.contains("_a", F.lit(r"\b"))
    plain = F.regexp_extract(F.replace("_a", F.lit(r"\b"), F.lit("")), r"(?U)\w+", 0)
    starts = F.coalesce(
        *[F.when(F.col("_a") == p, F.array(*[F.lit(t) for t in ts])) for p, ts in PATTERN_STARTS.items()], F.array(plain)
    )
    quoted = M.quoted(F.col("_a"))
    return rows.select(
        *reqs.columns, "alias_no",
        F.when(is_pattern, F.concat(F.lit("(?iU)"), F.col("_a"))).otherwise(F.concat(F.lit("(?i)"), quoted)).alias("pattern"),
        F.explode(starts).alias("token"),
    )


# The shortest line of an experience that counts, and the sections whose mentions carry no years.
MIN_EXPERIENCE_LINE = 3
WITHOUT_YEARS = ("certifications", "projects")


def presence_match(profile_lines: DataFrame, reqs: DataFrame, synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """First profile line mentioning a requirement, by section priority, with a snippet and the years stated with it.

    ``profile_lines``: role, candidate_id, section_prio, section, pos, text, and entry_pos if sections have several
    entries; ``reqs``: role, req_id, req_name. Lines meet aliases on (role, first token): a line keeps the tokens its
    role's aliases can begin with, a list as short as the aliases, and only the candidates found so are tested with the
    pattern. Years are those near an alias in the whole entry (for skills and others, section) of that line, else
    anywhere in it, else in the summary; certificates and projects have none. Only windows around years are joined to
    the mentions, no texts.
    """
    lines = profile_lines
    if "entry_pos" not in lines.columns:  # then an education line is an entry, any other section is one
        lines = lines.withColumn("entry_pos", F.when(F.col("section") == "education", F.col("pos").cast("long")).otherwise(0))
    aliases = small_side(requirement_aliases(reqs.select("role", "req_id", "req_name"), synonyms))
    wanted = small_side(aliases.groupBy("role").agg(F.collect_set("token").alias("_wanted")))
    hits = (
        lines.filter((F.col("section") != "experience") | (F.length("text") >= MIN_EXPERIENCE_LINE))
        .join(wanted, "role")
        .withColumn("token", F.explode(F.array_intersect(M.tokens(F.col("text")), "_wanted")))
        .drop("_wanted")
        .join(aliases, ["role", "token"])
        .filter(F.rlike("text", F.col("pattern")))
    )
    around = F.regexp_extract_all(
        F.col("_h.text"), F.concat(F.lit("(?s)(.{0,60}?(?:"), F.col("_h.pattern"), F.lit(").{0,220})")), F.lit(1)
    )[0]
    first = (
        hits.groupBy("role", "candidate_id", "req_id")
        .agg(F.min_by(F.struct("section", "pos", "text", "pattern", "entry_pos"), F.struct("section_prio", "entry_pos", "pos", "alias_no")).alias("_h"))
        .select(
            "role", "candidate_id", "req_id",
            F.col("_h.section").alias("section"), F.col("_h.pos").alias("pos"), F.col("_h.entry_pos").alias("entry_pos"),
            F.substr(F.trim(F.regexp_replace(around, r"\s+", " ")), F.lit(1), F.lit(220)).alias("snippet"),
        )
    )
    units = lines.filter(~F.col("section").isin(*WITHOUT_YEARS)).groupBy("role", "candidate_id", "section", "entry_pos").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_l")
    )
    windows = units.select("role", "candidate_id", "section", "entry_pos", M.years_windows(F.array_join(F.col("_l.text"), " | ")).alias("_w"))
    windows = durable(windows.filter(F.size("_w") > 0))
    summary = windows.filter(F.col("section") == "summary").groupBy("role", "candidate_id").agg(F.flatten(F.array_sort(F.collect_list("_w"))).alias("_s"))
    named = small_side(any_alias_pattern(reqs.select("role", "req_id", "req_name"), synonyms).select("role", "req_id", "pattern"))
    own = F.when(F.col("_w").isNotNull(), M.most_years(F.col("_w"), F.col("pattern"))).otherwise(0.0)
    more = F.when(F.col("_s").isNotNull(), M.most_years(F.col("_s"), F.col("pattern"))).otherwise(0.0)
    years = F.when(F.col("section").isin(*WITHOUT_YEARS), 0.0).when(own > 0, own).otherwise(more)
    return (
        first.join(windows, ["role", "candidate_id", "section", "entry_pos"], "left")
        .join(summary, ["role", "candidate_id"], "left")
        .join(named, ["role", "req_id"])
        .select("role", "candidate_id", "req_id", "section", "pos", "snippet", years.alias("years"))
    )


def any_alias_pattern(reqs: DataFrame, synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """Requirements with one pattern that matches any of their aliases."""
    rows = requirement_aliases(reqs, synonyms).select(*reqs.columns, "pattern").distinct()
    return rows.groupBy(*reqs.columns).agg(
        F.array_join(F.array_sort(F.collect_set("pattern")), "|").alias("pattern")
    )


def years_near_alias(texts: DataFrame, reqs: DataFrame, synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """Years stated near a requirement's aliases in a text, else anywhere in it, else in the summary.

    ``texts``: role, candidate_id, text, summary; ``reqs``: role, req_id, req_name. A text is cut once into the windows
    around its years phrases; windows meet aliases on (role, first token), and only those that share one are tested with
    the pattern. Texts themselves are joined with nothing.
    """
    aliases = small_side(requirement_aliases(reqs.select("role", "req_id", "req_name"), synonyms).select("role", "req_id", "token", "pattern").distinct())
    windows = durable(texts.select(
        F.monotonically_increasing_id().alias("_row"), "role", "candidate_id",
        M.years_windows(F.col("text")).alias("_own"), M.years_windows(F.coalesce("summary", F.lit(""))).alias("_more"),
    ))
    most = lambda name: F.coalesce(F.array_max(F.col(f"{name}.years")), F.lit(0.0))
    asked = windows.select("_row", "role", "candidate_id", most("_own").alias("_any"), most("_more").alias("_any_more")).join(
        small_side(reqs.select("role", "req_id").distinct()), "role"
    )
    parts = F.array(F.struct(F.lit(True).alias("own"), F.col("_own").alias("w")), F.struct(F.lit(False).alias("own"), F.col("_more").alias("w")))
    each = windows.select("_row", "role", F.inline(parts)).select("_row", "role", "own", F.inline("w"))
    hits = (
        each.withColumn("token", F.explode(M.tokens(F.col("window"))))
        .join(aliases, ["role", "token"])
        .filter(F.rlike("window", F.col("pattern")))
    )
    near = hits.groupBy("_row", "req_id").agg(
        F.max(F.when(F.col("own"), F.col("years"))).alias("_near"), F.max(F.when(~F.col("own"), F.col("years"))).alias("_near_more")
    )
    stated = lambda close, any_: F.when(F.col(close) > 0, F.col(close)).otherwise(F.col(any_))
    own = stated("_near", "_any")
    return asked.join(near, ["_row", "req_id"], "left").select(
        "role", "candidate_id", "req_id", F.when(own > 0, own).otherwise(stated("_near_more", "_any_more")).alias("years")
    )


def add_expected_years(reqs: DataFrame, text: str = "sq_text") -> DataFrame:
    return reqs.withColumn("expected_years", M.expected_years(F.col(text)))


def extract_grades(texts: DataFrame) -> DataFrame:
    return texts.withColumn("grade", M.grade(F.col("text")))


def code_only_req_score(
    candidates: DataFrame, sub_queries: DataFrame, degrees: DataFrame, certs: DataFrame, institutes: DataFrame, providers: DataFrame
) -> DataFrame:
    """Education, certificate and location requirements scored without a judge.

    ``candidates``: role, candidate_id, raw_text, grade; ``sub_queries``: role, req_id, req_name, weight_pct,
    sq_key, sq_text, kind; ``degrees``/``certs``: as for the matches; ``institutes``/``providers``: alias tables.
    Per sub-query: any degree, certificate or location match; the grade against the number in the question
    (7 without one); the tier of the first institution, or of the first certificate's provider or else its name. Contribution = weight x mean.
    """
    keys = ["role", "candidate_id", "req_id"]
    reqs = sub_queries.select("role", "req_id", "req_name").distinct()
    matched = (
        degree_match(degrees, reqs).filter("matched").select(*keys)
        .unionByName(certificate_match(certs, reqs))
        .unionByName(location_match(candidates, reqs).filter("matched").select(*keys))
        .distinct()
        .withColumn("_match", F.lit(True))
    )

    def first_points(rows: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
        first = rows.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy("role", "candidate_id").agg(
            F.min_by(column, "pos").alias("name")
        )
        return tier_lookup(first, aliases).select("role", "candidate_id", F.col("points").alias(out))

    # a certificate without a provider goes by its own name
    named = certs.withColumn("provider", F.coalesce(F.nullif(F.trim("provider"), F.lit("")), "cert"))
    target = F.coalesce(
        F.nullif(F.regexp_extract("sq_text", r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(7.0)
    )
    score = (
        F.when(F.col("kind") == "binary", binary_score(F.coalesce("_match", F.lit(False))))
        .when(F.col("kind") == "cgpa", grade_band(F.col("grade"), target))
        .when(F.col("kind") == "institution_rank", tier_band(F.col("_inst")))
        .when(F.col("kind") == "certificate_rank", tier_band(F.col("_cert")))
        .otherwise(0.01)
    )
    return (
        candidates.select("role", "candidate_id", "grade")
        .join(first_points(degrees, "institution", institutes, "_inst"), ["role", "candidate_id"], "left")
        .join(first_points(named, "provider", providers, "_cert"), ["role", "candidate_id"], "left")
        .join(small_side(sub_queries), "role")
        .join(matched, keys, "left")
        .withColumn("sub_score", score)
        .groupBy(*keys, "weight_pct")
        .agg(F.sum("sub_score").alias("sub_score_sum"), F.count(F.lit(1)).alias("n_sq"))
        .withColumn("contribution", F.round(F.col("weight_pct") * F.col("sub_score_sum") / F.col("n_sq"), 4))
        .drop("weight_pct")
    )
