"""The registered queries of the operators, over the driver's tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm import (
    decontamination, license_scan, mixing, near_dedup, periodic_runs, quality_classifier, quality_rules, secret_scan, token_alignment, token_counts, toxicity,
    url_filters, warc,
)
from rankwell.runtime import arrow_rows, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, trees)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return judged.select("doc_id", *[F.col(f"_quality.{n}").alias(n) for n in names])


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_document(mixing.mix(table(spark, sf_dir, "documents")))


# One level of the splitting tree: the first half of a node's blocks, in random order, goes to its left child.
_TREE = "".join(f"""
d{n} AS (
  SELECT node, rank, row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws('|', 7, node, rank, nth)), rank, nth) AS nr, count(*) OVER (PARTITION BY node) AS n
  FROM (SELECT node, rank, unnest(range(1, quota + 1)) AS nth FROM q{n})),
q{n + 1} AS (SELECT 2 * node + (nr > n // 2 + n % 2)::INT AS node, rank, count(*) AS quota FROM d{n} GROUP BY ALL),
""" for n in range(4))

ORACLES["op5_mixing"] = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(md5(text), ''))) AS k
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM sums),
filled AS (
  SELECT *, cap / w AS c,
    ((SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
goals AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS take, CAST(greatest(1, ceil(total / 4096)) AS BIGINT) AS width
  FROM (SELECT *, least(cap, w * (SELECT level FROM filled WHERE level <= c ORDER BY c, rank LIMIT 1)) AS target, sum(source_size) OVER () AS total FROM filled)),
q0 AS (SELECT CAST(1 AS BIGINT) AS node, rank, CAST(ceil(take / width) AS BIGINT) AS quota FROM goals WHERE take > 0),
""" + _TREE + """runs AS (SELECT *, CAST(sum(quota) OVER (PARTITION BY rank ORDER BY node) AS BIGINT) AS stop FROM q4),
permuted AS (
  SELECT rank, block, row_number() OVER (PARTITION BY rank ORDER BY md5(concat_ws('|', 7, rank, block)), block) AS nr
  FROM (SELECT rank, unnest(range(quota)) AS block FROM q0)),
drawn AS (
  SELECT p.rank, p.block, r.node - 16 AS shard,
    row_number() OVER (PARTITION BY r.node ORDER BY md5(concat_ws('|', 8, r.node - 16, p.rank, p.block)), p.rank, p.block) - 1 AS position
  FROM permuted p JOIN runs r ON p.rank = r.rank AND p.nr > r.stop - r.quota AND p.nr <= r.stop),
tape AS (
  SELECT row_number() OVER () AS place, d.doc_id, d.size, g.rank, g.source_size, g.target, g.take, g.width,
         CAST(sum(d.size) OVER (PARTITION BY g.rank ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
readings AS (
  SELECT *, e * source_size + start AS first, least(take, e * source_size + start + size) AS stop
  FROM tape, (SELECT unnest([0, 1, 2]) AS e) WHERE e * source_size + start < least(take, e * source_size + start + size)),
cut AS (SELECT *, unnest(range(first // width, (stop - 1) // width + 1)) AS block FROM readings),
pieces AS (
  SELECT c.place, d.shard, d.position, c.e, greatest(c.first, c.block * c.width) - c.first AS word,
         least(c.stop, (c.block + 1) * c.width) - greatest(c.first, c.block * c.width) AS n
  FROM cut c JOIN drawn d ON c.rank = d.rank AND c.block = d.block),
taken AS (
  SELECT place, CAST(sum(n) AS BIGINT) AS taken, count(DISTINCT shard) AS n_shards, count(*) AS n_pieces,
         sha256(string_agg(concat_ws(':', shard, position, e, word, n), ',' ORDER BY e, word)) AS spans_sha256
  FROM pieces GROUP BY place)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_shards, 0) AS n_shards,
       coalesce(n_pieces, 0) AS n_pieces, coalesce(spans_sha256, sha256('')) AS spans_sha256
FROM tape LEFT JOIN taken USING (place)
"""


@query
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.ledger_of(spark, f"{sf_dir.rstrip('/')}/documents.parquet"))
    base = tuple(r.kind for r in secret_scan.BASE_RULES)
    every = tuple(r.kind for r in secret_scan.RULES)
    n = lambda kind: F.size(F.filter("findings", lambda f: f["rule"] == kind)).cast("bigint")
    return found.select(
        F.col("path").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secret_scan.listed("findings", base), 256).alias("base_sha256"), secret_scan.listed("findings", every).alias("spans"),
    )


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The rules of the query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(pages, rules, url_filters.declared_links(pages))


ORACLES["op4_url_filters"] = r"""
WITH split AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, way) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
ruled AS (
  SELECT s.*,
    (SELECT h || p FROM rules WHERE (s.host = h OR s.host LIKE '%.' || h) AND starts_with(s.path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
    (SELECT way FROM rules WHERE (s.host = h OR s.host LIKE '%.' || h) AND starts_with(s.path, p) ORDER BY length(h || p) DESC LIMIT 1) AS own,
    regexp_replace(s.host, '^(www|m)\.([^.]+\.)', '\2') || regexp_replace(s.path, '(/|\.html?)$', '') || '?' || coalesce((
      SELECT string_agg(q, '&' ORDER BY q) FROM (SELECT unnest(string_split(regexp_extract(s.url, '(?s)^[^?#]*\?([^#]*)', 1), '&')) AS q)
      WHERE q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '') AS form
  FROM split s),
passed AS (SELECT form, min(own) AS passed_on FROM ruled WHERE host <> '' GROUP BY form)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN own WHEN host = '' THEN 'allow' ELSE coalesce(passed_on, 'allow') END AS verdict
FROM ruled LEFT JOIN passed USING (form)
"""


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""


def _fold(k: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % k, F.lit(-1))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(_fold(3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = quality_classifier.word_vectors(docs)
    network = quality_classifier.train(docs, labels.where(_fold(5) != 0), vectors)
    scored = quality_classifier.score(docs, vectors, network)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    summed = token_alignment.align(docs, *files, then=(token_alignment.SUMMARY, token_alignment.summary))
    path = scratch_path(spark, "links")
    with arrow_rows(spark, token_alignment.BATCH):
        summed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "_aligned.*").write.parquet(path)
    kept = spark.read.parquet(path)
    links = kept.select("row", F.inline("links"))
    counts = token_alignment.count_links(links.select("a_id", "b_id"), token_alignment.linkable(*files))
    sums = links.join(counts, ["a_id", "b_id"]).groupBy("row").agg(F.sum(F.col("best").cast("bigint")).alias("n_best"), F.sum("n").alias("count_sum"))
    none = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return kept.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256",
    )


TOKEN_LIMIT = 512


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), into="n_tokens")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def repeat_words(text: str | None, h: int | None) -> str | None:
    """The text with the words from some place on repeated with some period, if the checksum ``h`` ends in 0."""
    words = (text or "").encode().split()
    if h is None or h % 10 or not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    period = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return b" ".join([*words[:a], *(period * ((n - a) // len(period) + 1))[: n - a]]).decode()


def planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which one document of ten, by its id's checksum, repeats words from some place on."""

    @F.pandas_udf("string")
    def plant(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sums in batches:
            yield pd.Series([repeat_words(t, None if pd.isna(h) else int(h)) for t, h in zip(texts, sums)], dtype=object)

    return docs.select("doc_id", plant("text", F.crc32(F.col("doc_id").cast("string"))).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "_runs")
    runs = F.col("_runs.runs")
    longest = F.expr("array_min(transform(_runs.runs, r -> named_struct('a', -r.length, 'start', r.start, 'period', r.period)))")
    listed = F.expr("array_join(transform(_runs.runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    named = found.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), longest.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("_runs.collapsed", 256).alias("collapsed_sha256"))
    return named.selectExpr(
        "doc_id", "n_runs", "top.start AS start", "-top.a AS length", "top.period AS period", "(-1000 * top.a) div top.period AS exponent_milli", "runs_sha256", "collapsed_sha256",
    )
