"""Registered queries: ids, registries, caches, ledgers and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import identity as I, ranking as K
from rankwell.plans.catalog import Tables, query, view

AS_OF = "2024-02-01 00:00:00"

# Numbers have four digits or more: lpad alone would cut longer ones. Labelled documents are registered already; every document is seen in this run.
view("doc_paths", "SELECT concat('/data/', source, '/', CAST(doc_id AS STRING), '.json') AS source_path, source AS role, doc_id FROM {documents}")
view(
    "registry",
    """SELECT source_path, role, concat(role, '_CAND_', lpad(n, CAST(greatest(4, length(n)) AS INT), '0')) AS candidate_id,
              CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS allocated_at, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS last_seen_at
       FROM (SELECT p.source_path, role, CAST(row_number() OVER (PARTITION BY role ORDER BY p.doc_id) AS STRING) AS n
             FROM {doc_paths} p JOIN {labels} l ON p.doc_id = l.doc_id) x""",
)
view("seen_paths", "SELECT source_path, role FROM {doc_paths} WHERE role <> 'src3'")


@query(
    "allocate_ids",
    """SELECT r.source_path, r.role, candidate_id, allocated_at, CASE WHEN s.source_path IS NULL THEN last_seen_at ELSE TIMESTAMP '2024-02-01 00:00:00' END AS last_seen_at
       FROM {registry} r LEFT JOIN {seen_paths} s ON r.source_path = s.source_path
       UNION ALL SELECT source_path, n.role, n.role || '_CAND_' || printf('%04d', coalesce(base, 0) + i), TIMESTAMP '2024-02-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00'
       FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY source_path) AS i FROM {seen_paths} s WHERE NOT EXISTS (SELECT 1 FROM {registry} r WHERE r.source_path = s.source_path)) n
       LEFT JOIN (SELECT role, max(CAST(split_part(candidate_id, '_CAND_', 2) AS BIGINT)) AS base FROM {registry} GROUP BY role) b ON b.role = n.role""",
)
def _(t: Tables):
    return I.allocate_ids(t.registry, t.seen_paths, AS_OF)


view(
    "raw_ids",
    """SELECT concat(CASE WHEN c_nationkey = 1 THEN '' WHEN c_nationkey = 2 THEN '9' ELSE c_mktsegment END, '_CAND_', CASE WHEN c_nationkey = 3 THEN '1' ELSE lpad(CAST(c_custkey AS STRING), 5, '0') END) AS candidate_id FROM {customer}""",
)


@query(
    "parse_ids",
    """SELECT candidate_id, split_part(candidate_id, '_CAND_', 1) AS role, CAST(split_part(candidate_id, '_CAND_', 2) AS BIGINT) AS counter FROM {raw_ids}
       WHERE regexp_matches(candidate_id, '^[A-Za-z][A-Za-z0-9]*_CAND_[0-9][0-9][0-9][0-9]+$')""",
)
def _(t: Tables):
    return I.parse_ids(t.raw_ids)


@query("candidates_for_role", "SELECT * FROM {registry} WHERE role = 'src7'")
def _(t: Tables):
    return I.candidates_for_role(t.registry, "src7")


# Two workers registered overlapping halves of the page table.
view(
    "worker_registries",
    """SELECT 1 AS worker, url AS source_path, concat('a', CAST(page_id AS STRING)) AS candidate_id, page_id AS seq FROM {pages} WHERE length(html) < 6000
       UNION ALL SELECT 2, url, concat('b', CAST(page_id AS STRING)), page_id FROM {pages} WHERE length(html) > 3000""",
)


@query(
    "merge_registries",
    """SELECT source_path, worker, candidate_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY worker DESC, candidate_id DESC, seq DESC) AS pick
         FROM {worker_registries}) x WHERE pick = 1""",
)
def _(t: Tables):
    return I.merge_registries(t.worker_registries)


view("worker_counters", "SELECT l_linenumber AS worker, l_returnflag AS role, max(l_orderkey) AS next_counter FROM {lineitem} GROUP BY l_linenumber, l_returnflag")


@query("merge_counters", "SELECT role, max(next_counter) AS next_counter FROM {worker_counters} GROUP BY role")
def _(t: Tables):
    return I.merge_counters(t.worker_counters)


view("legacy_paths", "SELECT source_path, doc_id FROM {doc_paths}")
view("legacy_chunks", "SELECT concat('cand_', substr(sha1(p.source_path), 1, 12)) AS legacy_id FROM {legacy_paths} p JOIN {labels} l ON p.doc_id = l.doc_id")


@query(
    "legacy_hash_id",
    """SELECT source_path, p.doc_id, 'cand_' || substr(sha1(source_path), 1, 12) AS legacy_id, l.doc_id IS NOT NULL AS has_legacy_chunks
       FROM {legacy_paths} p LEFT JOIN {labels} l ON p.doc_id = l.doc_id""",
)
def _(t: Tables):
    return I.backfill_legacy_ids(t.legacy_paths, t.legacy_chunks)


# Whole documents as query texts, with stray spaces; English and French ones are cached.
view("cache_texts", "SELECT doc_id AS pos, lang, concat('  ', replace(text, ' ', '   '), ' ') AS sq_text FROM {documents}")
view(
    "cached",
    r"""SELECT lang AS model, sha2(trim(regexp_replace(lower(sq_text), '\\s+', ' ')), 256) AS cache_key FROM {cache_texts} WHERE lang IN ('en', 'fr')""",
    oracle=r"SELECT lang AS model, sha256(trim(regexp_replace(lower(sq_text), '\s+', ' ', 'g'))) AS cache_key FROM {cache_texts} WHERE lang IN ('en', 'fr')",
)


@query(
    "query_cache_key",
    r"""SELECT cache_key, pos, sq_text, 'en' AS model FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY pos) AS pick FROM (
          SELECT *, sha256(trim(regexp_replace(lower(sq_text), '\s+', ' ', 'g'))) AS cache_key FROM {cache_texts}) a) b
        WHERE pick = 1 AND NOT EXISTS (SELECT 1 FROM {cached} c WHERE c.model = 'en' AND c.cache_key = b.cache_key)""",
)
def _(t: Tables):
    return I.query_cache_misses(t.cache_texts.drop("lang"), t.cached, "en")


view("cache_rows", "SELECT doc_id AS pos, lang AS model, source AS role, md5(text) AS file_hash, md5(text) AS cache_key FROM {documents}")
view("current_sources", "SELECT source AS role, md5(text) AS file_hash FROM {documents} WHERE n_chars > 800")


@query(
    "cache_invalidate",
    """SELECT cache_key, pos, model, role, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY pos) AS pick FROM {cache_rows} c
         WHERE model = 'en' AND EXISTS (SELECT 1 FROM {current_sources} s WHERE s.role = c.role AND s.file_hash = c.file_hash)) x WHERE pick = 1""",
)
def _(t: Tables):
    return I.valid_cache(t.cache_rows, t.current_sources, "en")


view("ledger", "SELECT l_linestatus AS run_id, l_returnflag AS role, l_orderkey AS candidate_id FROM {lineitem} WHERE l_tax > 0.04")


@query(
    "resume_ledger",
    """SELECT * FROM {line_candidates} c WHERE NOT EXISTS (SELECT 1 FROM {ledger} l WHERE l.run_id = 'F' AND l.role = c.role AND l.candidate_id = c.candidate_id)""",
)
def _(t: Tables):
    return I.unscored(t.line_candidates, t.ledger, "F")


# Customers ranked by balance in their segment; a conversation turn asks for ranks, numbers and names.
view("customer_totals", "SELECT c_mktsegment AS role, c_custkey AS key, concat(c_mktsegment, '_CAND_', lpad(CAST(c_custkey AS STRING), CAST(greatest(4, length(CAST(c_custkey AS STRING))) AS INT), '0')) AS candidate_id, lower(c_name) AS name, c_acctbal AS total FROM {customer}")
view("customer_ranks_o", spark="SELECT 1", oracle="SELECT *, row_number() OVER (PARTITION BY role ORDER BY total DESC, key) AS rank FROM {customer_totals}")
view(
    "asked",
    """SELECT concat(CAST(conv_id AS STRING), '/', CAST(turn AS STRING)) AS question_id, CASE WHEN turn % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS role, conv_id, turn,
              concat('Compare Rank #', CAST(conv_id % 30 + 1 AS STRING), ' with the ', CAST(turn + 4 AS STRING), 'th one, candidate ', CAST(conv_id * 7 AS STRING), ' and Customer#', lpad(CAST(conv_id * 3 AS STRING), 9, '0'), '. ',
                     regexp_replace(text, '[0-9#]', '')) AS question FROM {conversations}""",
    oracle="""SELECT conv_id || '/' || turn AS question_id, CASE WHEN turn % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS role, conv_id, turn FROM conversations""",
)


@query(
    "resolve_candidate_refs",
    """SELECT question_id, q.role, candidate_id FROM {asked} q JOIN {customer_ranks_o} r ON q.role = r.role AND r.rank IN (conv_id % 30 + 1, turn + 4)
       UNION SELECT question_id, q.role, candidate_id FROM {asked} q JOIN {customer_ranks_o} r ON q.role = r.role AND r.name = 'customer#' || lpad(CAST(conv_id * 3 AS VARCHAR), 9, '0')
       UNION SELECT question_id, role, arg_min(candidate_id, (p, rank)) FROM (
         SELECT question_id, q.role, candidate_id, rank, CASE WHEN r.key = conv_id * 7 THEN 0 ELSE 1 END AS p FROM {asked} q JOIN {customer_ranks_o} r ON q.role = r.role
           AND (r.key = conv_id * 7 OR contains(candidate_id, 'CAND_' || (conv_id * 7)) OR contains(candidate_id, printf('CAND_%03d', conv_id * 7)))) x GROUP BY question_id, role""",
)
def _(t: Tables):
    ranked = K.row_numbers(t.customer_totals, ["role"], [F.col("total").desc(), F.col("key")])
    return I.resolve_references(t.asked, ranked)
