"""Registered queries: dates, tenure and degrees."""

from __future__ import annotations

from rankwell.operators import temporal as T
from rankwell.plans.catalog import Tables, query, view

AS_OF = (2003, 6)

# An order is a job entry of its customer; its key decides how the dates are written.
view(
    "job_entries",
    """SELECT o_custkey AS candidate_id, o_orderkey AS pos, form, y, m, CASE WHEN o_orderstatus = 'P' AND form = 3 THEN CAST(y AS STRING)
              WHEN o_orderstatus = 'O' AND form = 3 THEN '' ELSE concat('Firm ', o_orderstatus) END AS company,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Skills/Tools' WHEN '2-HIGH' THEN '' ELSE o_orderpriority END AS title,
         CASE WHEN o_totalprice > 200000 THEN 2 ELSE 0 END AS n_details,
         CASE form WHEN 0 THEN concat(mon, ' ', CAST(y AS STRING), ' - ', mon, 'uary ', CAST(y + 2 AS STRING))
                   WHEN 1 THEN concat(CAST(y AS STRING), ' - Present') WHEN 2 THEN concat(CAST(m AS STRING), '/', CAST(y AS STRING), ' — ', CAST(y + 1 AS STRING))
                   WHEN 3 THEN CAST(y AS STRING) WHEN 4 THEN concat('since ', CAST(y AS STRING), '-', mm, ' to ', CAST(y + 1 AS STRING), '-', mm, '!')
                   WHEN 5 THEN 'some random text' ELSE '' END AS dates
       FROM (SELECT *, CAST(o_orderkey % 7 AS INT) AS form, year(o_orderdate) AS y, month(o_orderdate) AS m,
                    substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3) AS mon,
                    lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm FROM {orders}) x""",
)
# What the texts above mean, straight from the order date ("January" is the only long name written right;
# a year followed by -MM closes a range as the bare year).
view(
    "parsed_o", spark="SELECT 1",
    oracle="""SELECT *, CASE WHEN form IN (0, 1, 2, 3, 4) THEN y END AS start_year,
         CASE form WHEN 0 THEN m WHEN 2 THEN m WHEN 3 THEN 1 WHEN 4 THEN m END AS start_month,
         CASE form WHEN 0 THEN CASE WHEN m = 1 THEN y + 2 END WHEN 1 THEN 2003 WHEN 2 THEN y + 1 WHEN 3 THEN y WHEN 4 THEN y + 1 END AS end_year,
         CASE form WHEN 0 THEN CASE WHEN m = 1 THEN m END WHEN 1 THEN 6 WHEN 3 THEN 12 END AS end_month,
         form = 1 AS is_current, form = 3 AS inferred_full_year,
         CASE form WHEN 0 THEN CASE WHEN m = 1 THEN 25 ELSE greatest(0, 2003 * 12 + 12 - (y * 12 + m) + 1) END
                   WHEN 1 THEN greatest(0, 2003 * 12 + 6 - (y * 12 + 1) + 1) WHEN 2 THEN 12 + 12 - m + 1 WHEN 3 THEN 12 WHEN 4 THEN 25 - m END AS months
       FROM {job_entries}""",
)
view(
    "guarded_o", spark="SELECT 1",
    oracle="""SELECT * EXCLUDE (months, inferred_full_year), inferred_full_year AND ok AS inferred_full_year,
         CASE WHEN inferred_full_year AND NOT ok THEN 0 ELSE months END AS months
       FROM (SELECT *, company LIKE 'Firm%' AND (title <> '' OR n_details > 0) AND title <> 'Skills/Tools' AS ok FROM {parsed_o}) x""",
)


def parsed(t: Tables):
    return T.parse_dates(t.job_entries, AS_OF)


_COLS = ["candidate_id", "pos", "dates", "start_year", "start_month", "end_year", "end_month", "is_current", "months", "inferred_full_year"]


@query("parse_date_range", f"SELECT {', '.join(_COLS)} FROM {{parsed_o}}")
def _(t: Tables):
    return parsed(t).select(*_COLS)


@query("single_year_guard", "SELECT candidate_id, pos, months, inferred_full_year FROM {guarded_o}")
def _(t: Tables):
    return T.guard_single_years(parsed(t)).select("candidate_id", "pos", "months", "inferred_full_year")


@query(
    "inferred_full_year_flags",
    """SELECT candidate_id, start_year AS year, dates, company AS employer, title AS role_text, months AS inferred_months,
              'inferred_full_year' AS flag_type FROM {guarded_o} WHERE inferred_full_year""",
)
def _(t: Tables):
    return T.full_year_flags(T.guard_single_years(parsed(t)))


_MERGE = """SELECT candidate_id, sum(e - s + 1) AS months FROM (
      SELECT candidate_id, island, min(s) AS s, max(e) AS e FROM (
        SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY candidate_id ORDER BY s, e, pos) AS island FROM (
          SELECT *, coalesce(s > max(e) OVER (PARTITION BY candidate_id ORDER BY s, e, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh
          FROM {source} ) a) b GROUP BY candidate_id, island) c GROUP BY candidate_id"""

# The order date opens an interval of up to two years; every eleventh order is open-ended or current.
view(
    "employment",
    """SELECT o_custkey AS candidate_id, o_orderkey AS pos, o_orderpriority AS company, o_orderstatus AS title, o_orderkey % 11 = 1 AS is_current,
              CASE WHEN o_orderkey % 13 = 0 THEN CAST(year(o_orderdate) AS STRING)
                   ELSE concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) END AS start_date,
              CASE WHEN o_orderkey % 11 < 2 THEN NULL ELSE concat(CAST(CAST(floor((year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 24) / 12) AS INT) AS STRING), '-',
                   lpad(CAST((month(o_orderdate) - 1 + o_orderkey % 24) % 12 + 1 AS STRING), 2, '0')) END AS end_date FROM {orders}""",
)
view(
    "employment_o", spark="SELECT 1",
    oracle="""SELECT *, coalesce(e0, CASE WHEN is_current THEN 2003 * 12 + 6 END, s) AS e FROM (
         SELECT candidate_id, pos, company, title, is_current,
           CASE WHEN length(start_date) = 4 THEN CAST(start_date AS INT) * 12 + 6 ELSE CAST(start_date[1:4] AS INT) * 12 + CAST(start_date[6:7] AS INT) END AS s,
           CASE WHEN end_date IS NOT NULL THEN CAST(end_date[1:4] AS INT) * 12 + CAST(end_date[6:7] AS INT) END AS e0 FROM {employment}) x""",
)


@query(
    "experience_months_merged",
    f"""SELECT m.candidate_id, m.months AS total_months, latest_title, latest_company
        FROM ({_MERGE.replace('{source}', '{employment_o}')}) m
        JOIN (SELECT candidate_id, arg_max(title, (e, -pos)) AS latest_title, arg_max(company, (e, -pos)) AS latest_company
              FROM {{employment_o}} GROUP BY candidate_id) l ON m.candidate_id = l.candidate_id""".replace("{{", "{").replace("}}", "}"),
)
def _(t: Tables):
    return T.experience_months_merged(t.employment, AS_OF)


@query(
    "experience_years_profile",
    """SELECT a.candidate_id, round(coalesce(b.months, a.summed) / 12.0, 1) AS years
       FROM (SELECT candidate_id, coalesce(sum(months) FILTER (WHERE months > 0), 0) AS summed FROM {guarded_o} GROUP BY candidate_id) a
       LEFT JOIN ("""
    + _MERGE.replace(
        "{source}",
        """(SELECT candidate_id, pos, start_year * 12 + coalesce(start_month, 1) AS s, end_year * 12 + coalesce(end_month, 12) AS e
            FROM {guarded_o} WHERE months > 0 AND start_year IS NOT NULL AND end_year IS NOT NULL)""",
    )
    + ") b ON a.candidate_id = b.candidate_id",
)
def _(t: Tables):
    return T.experience_years(T.guard_single_years(parsed(t)))


@query(
    "experience_months_simple",
    """SELECT candidate_id, coalesce(sum(greatest(0, e - s)), 0) AS total_months FROM (
         SELECT candidate_id, CASE WHEN length(start_date) = 4 THEN s - 5 ELSE s END AS s,
                CASE WHEN is_current OR end_date IS NULL THEN 2003 * 12 + 6 ELSE e0 END AS e
         FROM (SELECT e.*, o.s, o.e0 FROM {employment} e JOIN {employment_o} o ON e.pos = o.pos) y) x GROUP BY candidate_id""",
)
def _(t: Tables):
    return T.experience_months_simple(t.employment, AS_OF)


view(
    "degrees",
    """SELECT o_custkey AS candidate_id, o_orderkey AS pos,
              CASE o_orderpriority WHEN '1-URGENT' THEN concat('B.Tech ', o_orderstatus) WHEN '2-HIGH' THEN 'Executive MBA'
                   WHEN '3-MEDIUM' THEN 'Diploma' WHEN '4-NOT SPECIFIED' THEN concat('Course ', o_orderstatus) ELSE 'PhD Physics' END AS degree
       FROM {orders}""",
)


@query(
    "highest_degree",
    """SELECT candidate_id, arg_min(degree, (CASE WHEN degree LIKE 'PhD%' THEN 0 WHEN degree LIKE '%MBA' THEN 9 WHEN degree LIKE 'B.Tech%' THEN 14
              WHEN degree = 'Diploma' THEN 24 ELSE 99 END, pos)) AS highest_degree FROM {degrees} GROUP BY candidate_id""",
)
def _(t: Tables):
    return T.highest_degree(t.degrees)
