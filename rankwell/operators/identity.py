"""Candidate ids, registries, caches and ledgers: everything that makes a rerun incremental."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.operators.ranking import row_numbers
from rankwell.runtime import BROADCAST_ROWS, durable, small_side

ROLE = r"^[A-Za-z][A-Za-z0-9]*$"
CANDIDATE_ID = r"^([A-Za-z][A-Za-z0-9]*)_CAND_(\d{4,})$"


def allocate_ids(registry: DataFrame, paths: DataFrame, as_of: str) -> DataFrame:
    """The registry after seeing ``paths`` (source_path, role): known paths keep their id and are touched, new
    ones continue their role's numbering in path order. A role name with other than letters and digits fails.

    ``registry``: source_path, role, candidate_id, allocated_at, last_seen_at.
    """
    now = F.lit(as_of).cast("timestamp")
    seen = paths.select("source_path").distinct().withColumn("_seen", F.lit(True))
    kept = registry.join(seen, "source_path", "left").withColumn(
        "last_seen_at", F.when(F.col("_seen"), now).otherwise(F.col("last_seen_at"))
    ).drop("_seen")
    valid = F.assert_true(F.rlike("role", F.lit(ROLE)), F.concat(F.lit("invalid role name: "), "role")).isNull()
    fresh = paths.groupBy("source_path").agg(F.min("role").alias("role")).filter(valid).join(
        registry.select("source_path"), "source_path", "left_anti"
    )
    highest = registry.groupBy("role").agg(F.max(counter_of(F.col("candidate_id"))).alias("_base"))
    numbered = row_numbers(fresh, ["role"], [F.col("source_path")], "_n").join(small_side(highest), "role", "left")
    number = F.coalesce("_base", F.lit(0)) + F.col("_n")
    return kept.unionByName(
        numbered.select(
            "source_path", "role", F.format_string("%s_CAND_%04d", "role", number).alias("candidate_id"),
            now.alias("allocated_at"), now.alias("last_seen_at"),
        ).select(*kept.columns)
    )


def counter_of(candidate_id: Column) -> Column:
    return F.nullif(F.regexp_extract(candidate_id, CANDIDATE_ID, 2), F.lit("")).try_cast("long")


def parse_ids(ids: DataFrame) -> DataFrame:
    """Role and counter of well-formed ids; others drop out."""
    return ids.filter(F.rlike("candidate_id", F.lit(CANDIDATE_ID))).select(
        "candidate_id",
        F.regexp_extract("candidate_id", CANDIDATE_ID, 1).alias("role"),
        counter_of(F.col("candidate_id")).alias("counter"),
    )


def candidates_for_role(registry: DataFrame, role: str) -> DataFrame:
    return registry.filter(F.col("role") == role)


def merge_registries(registries: DataFrame) -> DataFrame:
    """Union of worker registries: per path the later worker's entry. ``registries``: worker, source_path, ..."""
    rest = [c for c in registries.columns if c != "source_path"]
    return registries.groupBy("source_path").agg(
        F.max_by(F.struct(*rest), F.struct("worker", *[c for c in rest if c != "worker"])).alias("_r")
    ).select("source_path", *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_counters(counters: DataFrame) -> DataFrame:
    """Next counter per role over all workers. ``counters``: worker, role, next_counter."""
    return counters.groupBy("role").agg(F.max("next_counter").alias("next_counter"))


def legacy_hash_id(path: Column) -> Column:
    return F.concat(F.lit("cand_"), F.substr(F.sha1(path), F.lit(1), F.lit(12)))


def backfill_legacy_ids(registry: DataFrame, legacy_chunks: DataFrame) -> DataFrame:
    """Registry with legacy ids and whether chunks exist under them. ``legacy_chunks``: legacy_id."""
    known = legacy_chunks.select("legacy_id").distinct().withColumn("_known", F.lit(True))
    return (
        registry.withColumn("legacy_id", legacy_hash_id(F.col("source_path")))
        .join(known, "legacy_id", "left")
        .withColumn("has_legacy_chunks", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def cache_key(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def query_cache_misses(sub_queries: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct sub-query texts not cached for the model, the first one per key.

    ``sub_queries``: pos, sq_text; ``cache``: model, cache_key.
    """
    keyed = sub_queries.withColumn("cache_key", cache_key(F.col("sq_text")))
    firsts = keyed.groupBy("cache_key").agg(F.min_by(F.struct("pos", "sq_text"), "pos").alias("_q"))
    return firsts.join(cache.filter(F.col("model") == model), "cache_key", "left_anti").select(
        "cache_key", "_q.pos", "_q.sq_text", F.lit(model).alias("model")
    )


def valid_cache(cache: DataFrame, sources: DataFrame, model: str) -> DataFrame:
    """Cached rows of the current model whose source document is unchanged; first of duplicate keys.

    ``cache``: pos, model, role, file_hash, cache_key; ``sources``: role, file_hash.
    """
    rest = [c for c in cache.columns if c != "cache_key"]
    return (
        cache.filter(F.col("model") == model)
        .join(sources.select("role", "file_hash").distinct(), ["role", "file_hash"], "left_semi")
        .groupBy("cache_key")
        .agg(F.min_by(F.struct(*rest), "pos").alias("_r"))
        .select("cache_key", *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def unscored(candidates: DataFrame, ledger: DataFrame, run_id: str) -> DataFrame:
    """Candidates the run has not scored yet. ``ledger``: run_id, role, candidate_id."""
    return candidates.join(ledger.filter(F.col("run_id") == run_id), ["role", "candidate_id"], "left_anti")


#: How many first characters make a name's head, the most that fit a broadcast; up to how many heads one pattern holds; how many
#: places of a text a window holds.
HEADS, FEW_HEADS, WINDOW = (8, 5, 3), 16, 64


def name_mentions(questions: DataFrame, rankings: DataFrame) -> DataFrame:
    """Candidates whose full name, in any case, occurs in a question of their role.

    ``questions``: question_id, role, question; ``rankings``: role, candidate_id, name. A name starts where its head does:
    places of a question are looked up among the role's heads, which are few, and only where one stands are
    the lengths of its names cut out and compared.
    """
    named = rankings.select("role", "candidate_id", F.lower("name").alias("_name")).filter(F.coalesce("_name", F.lit("")) != "")

    def head(width: int) -> Column:
        return F.substr("_name", F.lit(1), F.lit(width))

    kinds = named.agg(*[F.approx_count_distinct(F.struct("role", head(w), F.length("_name"))) for w in HEADS]).first()
    width = next((w for w, n in zip(HEADS, kinds) if n <= BROADCAST_ROWS // 2), HEADS[-1])
    heads = small_side(named.select("role", head(width).alias("_head"), F.length("_name").alias("_len")).distinct())
    # Names shorter than the width are heads of their own size.
    sizes = small_side(heads.groupBy("role", F.length("_head").alias("_size")).agg(F.max("_len").alias("_long")))
    texts = [r._head for r in heads.select("_head").distinct().limit(FEW_HEADS + 1).collect()]
    asked = questions.select("question_id", "role", F.lower("question").alias("_q"))
    if 0 < len(texts) <= FEW_HEADS:
        longest = sizes.agg(F.max("_long")).first()[0]
        starts = _starts_of(asked, texts, longest).join(sizes, "role").withColumn("_i", F.lit(1))
    else:
        starts = _all_places(asked.join(sizes, "role"))
    found = (
        starts.withColumn("_head", F.coalesce(F.substr("_w", F.col("_i"), F.col("_size")), F.lit("")))
        .join(heads, ["role", "_head"])
        .select("question_id", "role", F.substr("_w", F.col("_i"), F.col("_len")).alias("_name"))
        .distinct()
    )
    return found.join(named, ["role", "_name"]).select("question_id", "role", "candidate_id")


def _starts_of(asked: DataFrame, texts: list[str], longest: int) -> DataFrame:
    """What follows every place where one of ``texts`` starts in ``_q``, with it and up to ``longest`` characters, as ``_w``."""
    literals = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in text) for text in texts)
    ahead = F.lit(f"(?s)(?=(?:{literals}))(?=(.{{1,{longest}}}))")
    return asked.select("question_id", "role", F.explode(F.regexp_extract_all("_q", ahead, F.lit(1))).alias("_w"))


def _all_places(asked: DataFrame) -> DataFrame:
    """Every place of ``_q`` as ``_i`` in a window ``_w``, which holds the ``_long`` characters from there on as well.

    Windows overlap; texts are cut into them once, since a place is found by counting from the start.
    """
    places = F.greatest(F.lit(WINDOW), F.col("_long"))
    windows = asked.select(
        "question_id", "role", "_size", "_long", "_q", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_q")), places)).alias("_from")
    ).select("question_id", "role", "_size", places.alias("_places"), F.substr("_q", F.col("_from"), places + F.col("_long") - 1).alias("_w"))
    last = F.greatest(F.lit(1), F.least(F.col("_places"), F.length("_w")))
    return windows.select("question_id", "role", "_size", "_w", F.explode(F.sequence(F.lit(1), last)).alias("_i"))


def resolve_references(questions: DataFrame, rankings: DataFrame) -> DataFrame:
    """Candidates a question names by rank, by number or by full name.

    ``questions``: question_id, role, question; ``rankings``: role, candidate_id, rank, name. ``rank 3`` and
    ``3rd`` mean ranks, ``candidate 7`` the id ending in that number, else an id holding it (best rank first).
    """
    low = F.lower("question")

    def numbers(*patterns: str) -> Column:
        return F.array_distinct(F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in patterns]))

    # Texts are searched for numbers once.
    asked_for = durable(questions.select(
        "question_id", "role",
        numbers(r"(?:rank|position|place)\s*(?:#|no\.?)?\s*(\d+)", r"(\d+)(?:st|nd|rd|th)\s*(?:rank|candidate|one)?").alias("_ranks"),
        numbers(r"(?:candidate|cand)\s*(?:#|no\.?)?\s*(\d+)").alias("_numbers"),
    ))
    ranks = asked_for.select("question_id", "role", F.explode("_ranks").alias("rank")).withColumn("rank", F.col("rank").try_cast("long"))
    by_rank = ranks.join(rankings, ["role", "rank"])

    asked = asked_for.select("question_id", "role", F.explode("_numbers").alias("_n")).withColumn("_n", F.col("_n").try_cast("long"))
    exact = rankings.withColumn("_n", counter_of(F.col("candidate_id"))).select("role", "candidate_id", "_n", "rank")
    digits = rankings.select("role", "candidate_id", "rank", F.regexp_extract("candidate_id", r"CAND_(\d+)", 1).alias("_d"))
    # An id holds CAND_7 when its digits start with 7, so every prefix of the digits is a key.
    prefixes = digits.select(
        "role", "rank",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_d"), F.lit(1))), lambda i: F.substr("_d", F.lit(1), i))).alias("_key"),
    )
    # Only the best rank of a key can be chosen, and it is found before any question is looked at.
    best = prefixes.groupBy("role", "_key").agg(F.min("rank").alias("rank"))
    spelled = asked.withColumn(
        "_key", F.explode(F.array_distinct(F.array(F.col("_n").cast("string"), F.format_string("%03d", F.col("_n")))))
    )
    loose = (
        spelled.join(best, ["role", "_key"]).join(digits, ["role", "rank"]).filter(F.startswith("_d", "_key"))
        .select("question_id", "role", "_n", "candidate_id", "rank", F.lit(1).alias("_p"))
    )
    tight = asked.join(exact, ["role", "_n"]).select("question_id", "role", "_n", "candidate_id", "rank", F.lit(0).alias("_p"))
    by_number = tight.unionByName(loose).groupBy("question_id", "role", "_n").agg(
        F.min_by("candidate_id", F.struct("_p", "rank")).alias("candidate_id")
    )

    by_name = name_mentions(questions, rankings)
    columns = ["question_id", "role", "candidate_id"]
    return by_rank.select(*columns).unionByName(by_number.select(*columns)).unionByName(by_name).distinct()
