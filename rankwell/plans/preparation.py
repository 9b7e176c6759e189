"""Registered queries: requirements and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import preparation as P
from rankwell.plans.catalog import Tables, query, view

# A part is a requirement: type = role, brand = category; small sizes stay unrated.
view("part_reqs", "SELECT p_type AS role, p_partkey AS req_id, p_name AS name, p_brand AS category, p_size AS size FROM {part}")
view(
    "part_weights",
    """SELECT p_type AS role, p_partkey AS req_id,
              round(100 * p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_type), 4) AS weight_pct
       FROM {part} WHERE p_size > 10""",
)
view(
    "raw_reqs",
    """SELECT p_type AS role, p_partkey AS part, CASE WHEN p_size < 20 THEN '' WHEN p_size > 40 THEN NULL ELSE concat('REQ-', p_brand) END AS req_id,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS name,
       CASE p_brand WHEN 'Brand#1' THEN 'Experience' WHEN 'Brand#2' THEN 'Education' WHEN 'Brand#3' THEN 'Preferred Skill' ELSE p_brand END AS category,
       CASE WHEN p_size > 25 THEN 'preferred' ELSE 'wanted' END AS type, CASE WHEN p_retailprice > 950 THEN 'GREEN' END AS status FROM {part}""",
)


@query(
    "sanitize_requirements",
    """SELECT role, pos, coalesce(nullif(req_id, ''), printf('REQ-%03d', pos)) AS req_id, coalesce(name, 'Requirement ' || pos) AS name,
              CASE WHEN category IN ('Core Skill', 'Preferred Skill', 'Experience', 'Education', 'Certification') THEN category ELSE 'Core Skill' END AS category,
              CASE WHEN type IN ('required', 'preferred') THEN type ELSE 'required' END AS type, coalesce(status, 'YELLOW') AS status
       FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY part) AS pos FROM {raw_reqs}) x""",
)
def _(t: Tables):
    return P.sanitize_requirements(P.number_requirements(t.raw_reqs, "part"))


view(
    "weight_overrides",
    "SELECT p_type AS role, p_partkey AS req_id, p_retailprice / 1000 AS weight_pct FROM {part} WHERE p_size > 45",
)


@query(
    "default_weights",
    """SELECT r.role, r.req_id, round(coalesce(o.weight_pct, 100.0 / count(*) OVER (PARTITION BY r.role)), 6) AS weight_pct
       FROM {part_reqs} r LEFT JOIN {weight_overrides} o ON r.role = o.role AND r.req_id = o.req_id""",
)
def _(t: Tables):
    return P.default_weights(t.part_reqs, t.weight_overrides).select("role", "req_id", F.round("weight_pct", 6).alias("weight_pct"))


# Two roles are saved again with renamed requirements; line items of a part are its sub-queries.
view("saved_reqs", "SELECT p_type AS role, p_partkey AS req_id, p_name AS name, CAST(0 AS BIGINT) AS subquery_count FROM {part}")
view(
    "new_reqs",
    "SELECT p_type AS role, p_partkey AS req_id, concat('new ', p_name) AS name FROM {part} WHERE p_type IN ('PROMO', 'SMALL') AND p_size > 5",
)
view("part_sub_queries", "SELECT p_type AS role, l_partkey AS req_id, l_linenumber AS sq_key FROM {lineitem} JOIN {part} ON l_partkey = p_partkey")


@query(
    "replace_role_requirements",
    """SELECT role, req_id, name, subquery_count FROM {saved_reqs} WHERE role NOT IN (SELECT role FROM {new_reqs})
       UNION ALL SELECT n.role, n.req_id, n.name, coalesce(c.n, 0) FROM {new_reqs} n
       LEFT JOIN (SELECT role, req_id, count(*) AS n FROM {part_sub_queries} GROUP BY ALL) c ON c.role = n.role AND c.req_id = n.req_id""",
)
def _(t: Tables):
    return P.replace_role_requirements(t.saved_reqs, t.new_reqs, t.part_sub_queries)


@query(
    "weight_summary",
    """SELECT role, category, round(coalesce(sum(weight_pct), 0), 6) AS total, count(*) AS n_requirements, count(weight_pct) AS n_rated,
              count(*) - count(weight_pct) AS n_unrated, round(100 - coalesce(sum(weight_pct), 0), 6) AS remaining,
              CASE WHEN category IS NULL THEN abs(sum(weight_pct) - 100) <= 0.01 AND count(*) FILTER (WHERE weight_pct < 0 OR weight_pct > 100) = 0 END AS valid
       FROM (SELECT r.role, r.category, w.weight_pct FROM {part_reqs} r LEFT JOIN {part_weights} w ON r.role = w.role AND r.req_id = w.req_id) x
       GROUP BY GROUPING SETS ((role, category), (role))""",
)
def _(t: Tables):
    out = P.weight_summary(t.part_reqs, t.part_weights)
    return out.withColumn("total", F.round("total", 6)).withColumn("remaining", F.round("remaining", 6))


@query(
    "unrated_requirements",
    "SELECT * FROM {part_reqs} r WHERE NOT EXISTS (SELECT 1 FROM {part_weights} w WHERE w.role = r.role AND w.req_id = r.req_id)",
)
def _(t: Tables):
    return P.unrated_requirements(t.part_reqs, t.part_weights)


view("roles", "SELECT DISTINCT o_orderpriority AS role FROM {orders} UNION SELECT DISTINCT p_type AS role FROM {part}")
view("configs", "SELECT DISTINCT p_type AS role, p_size AS config FROM {part}")


@query(
    "role_catalog",
    """SELECT r.role, coalesce(n_requirements, 0) AS n_requirements, coalesce(n_configurations, 0) AS n_configurations FROM {roles} r
       LEFT JOIN (SELECT role, count(*) AS n_requirements FROM {part_reqs} WHERE category = 'Brand#7' GROUP BY role) a ON a.role = r.role
       LEFT JOIN (SELECT role, count(*) AS n_configurations FROM {configs} GROUP BY role) b ON b.role = r.role""",
)
def _(t: Tables):
    return P.role_catalog(t.roles, t.part_reqs, t.configs, category="Brand#7")


view(
    "export_inputs",
    """SELECT r.role, r.req_id, name, category, 'required' AS type, CAST(weight_pct AS DECIMAL(14,4)) AS weight_pct, r.size AS expected_years
       FROM {part_reqs} r JOIN {part_weights} w ON r.role = w.role AND r.req_id = w.req_id""",
)


@query(
    "export_weight_config",
    """SELECT role, category, CAST(req_id AS VARCHAR) AS part,
         '{"requirement_id":' || req_id || ',"requirement_name":"' || name || '","category":"' || category || '","type":"required","weight_percentage":'
         || weight_pct || ',"expected_years":' || expected_years || ',"label":"' || name || ' (' || weight_pct || '%)"}' AS record FROM {export_inputs}
       UNION ALL SELECT role, category, 'total', '{"category":"' || category || '","total":' || CAST(sum(weight_pct) AS DECIMAL(14,4)) || ',"count":' || count(*) || '}'
       FROM {export_inputs} GROUP BY role, category""",
)
def _(t: Tables):
    return P.export_weight_config(t.export_inputs)
