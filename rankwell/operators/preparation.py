"""Requirements and weights before scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.operators.ranking import row_numbers
from rankwell.runtime import small_side

# What a requirement may be, and what it falls back to.
CATEGORIES = ["Core Skill", "Preferred Skill", "Experience", "Education", "Certification"]
TYPES = ["required", "preferred"]
STATUSES = ["GREEN", "YELLOW", "RED"]
DEFAULT_CATEGORY, DEFAULT_TYPE, DEFAULT_STATUS = "Core Skill", "required", "YELLOW"


def sanitize_requirements(reqs: DataFrame) -> DataFrame:
    """Fill missing ids and names from the position and replace values outside the allowed sets.

    ``reqs``: role, pos (1-based), req_id, name, category, type, status.
    """
    number = F.format_string("REQ-%03d", F.col("pos"))
    return reqs.select(
        "role", "pos",
        F.coalesce(F.nullif("req_id", F.lit("")), number).alias("req_id"),
        F.coalesce(F.nullif("name", F.lit("")), F.format_string("Requirement %d", F.col("pos"))).alias("name"),
        *[
            F.when(F.col(c).isin(allowed), F.col(c)).otherwise(default).alias(c)
            for c, allowed, default in (
                ("category", CATEGORIES, DEFAULT_CATEGORY),
                ("type", TYPES, DEFAULT_TYPE),
                ("status", STATUSES, DEFAULT_STATUS),
            )
        ],
    )


def number_requirements(reqs: DataFrame, order: str) -> DataFrame:
    """Adds the 1-based ``pos`` of each requirement within its role."""
    return row_numbers(reqs, ["role"], [F.col(order)], out="pos")


def default_weights(reqs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every requirement of a role weighs 100/n unless overridden; the sum is then not corrected."""
    n = reqs.groupBy("role").agg(F.count(F.lit(1)).alias("_n"))
    return (
        reqs.join(small_side(n), "role")
        .join(overrides.select("role", "req_id", F.col("weight_pct").alias("_o")), ["role", "req_id"], "left")
        .withColumn("weight_pct", F.coalesce("_o", 100.0 / F.col("_n")))
        .drop("_o", "_n")
    )


def replace_role_requirements(saved: DataFrame, new: DataFrame, sub_queries: DataFrame) -> DataFrame:
    """Requirements after re-saving some roles: their old rows go, the new ones come with a sub-query count."""
    counts = sub_queries.groupBy("role", "req_id").agg(F.count(F.lit(1)).alias("_n"))
    fresh = new.join(counts, ["role", "req_id"], "left").withColumn("subquery_count", F.coalesce("_n", F.lit(0))).drop("_n")
    kept = saved.join(new.select("role").distinct(), "role", "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def weight_summary(reqs: DataFrame, weights: DataFrame) -> DataFrame:
    """Per role and category: total, requirements, rated, unrated, remaining; the null category is the role.

    ``valid`` (role rows only): total within 0.01 of 100, no weight negative or above 100.
    """
    joined = reqs.join(weights.select("role", "req_id", "weight_pct"), ["role", "req_id"], "left")
    bad = F.count_if((F.col("weight_pct") < 0) | (F.col("weight_pct") > 100))
    return (
        joined.rollup("role", "category")
        .agg(
            F.coalesce(F.sum("weight_pct"), F.lit(0.0)).alias("total"),
            F.count(F.lit(1)).alias("n_requirements"),
            F.count("weight_pct").alias("n_rated"),
            F.count_if(F.col("weight_pct").isNull()).alias("n_unrated"),
            bad.alias("_bad"),
        )
        .filter(F.col("role").isNotNull())
        .withColumn("remaining", 100.0 - F.col("total"))
        .withColumn(
            "valid", F.when(F.col("category").isNull(), (F.abs(F.col("total") - 100) <= 0.01) & (F.col("_bad") == 0))
        )
        .drop("_bad")
    )


def unrated_requirements(reqs: DataFrame, weights: DataFrame) -> DataFrame:
    return reqs.join(weights, ["role", "req_id"], "left_anti")


def role_catalog(roles: DataFrame, reqs: DataFrame, configs: DataFrame, category: str | None = None) -> DataFrame:
    """Roles with their number of requirements (optionally of one category) and of weight configurations."""
    if category is not None:
        reqs = reqs.filter(F.col("category") == category)
    n_req = reqs.groupBy("role").agg(F.count(F.lit(1)).alias("n_requirements"))
    n_cfg = configs.groupBy("role").agg(F.count(F.lit(1)).alias("n_configurations"))
    return roles.join(n_req, "role", "left").join(n_cfg, "role", "left").fillna(0, ["n_requirements", "n_configurations"])


def export_weight_config(weights: DataFrame) -> DataFrame:
    """A weight configuration as JSON records: one per requirement and one per category with its total.

    ``weights``: role, req_id, name, category, type, weight_pct (decimal), expected_years. Records instead of
    one document per role, so that no role is gathered in one row.
    """
    reqs = weights.select(
        "role", "category", F.col("req_id").cast("string").alias("part"),
        F.to_json(
            F.struct(
                F.col("req_id").alias("requirement_id"), F.col("name").alias("requirement_name"), "category", "type",
                F.col("weight_pct").alias("weight_percentage"), "expected_years",
                F.format_string("%s (%s%%)", "name", F.col("weight_pct").cast("string")).alias("label"),
            )
        ).alias("record"),
    )
    totals = (
        weights.groupBy("role", "category")
        .agg(F.sum("weight_pct").cast("decimal(14,4)").alias("total"), F.count(F.lit(1)).alias("count"))
        .select("role", "category", F.lit("total").alias("part"), F.to_json(F.struct("category", "total", "count")).alias("record"))
    )
    return reqs.unionByName(totals)
