r"""URL filters: allow and block rules, propagated over redirect equivalence.

URLs joined by redirects or canonical links are aliases. Their components are found with distributed star steps; a block
decision on one alias reaches those without a rule of their own, unless an alias is allowed explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import connected_components, lower_ascii
from rankwell.runtime import durable


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The address that a URL implies as its own canonical form.

    Without scheme, a leading ``www.`` or ``m.``, fragment, tracking parameters, and a closing slash or ``.html``; null
    where there is no host.
    """
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html?)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def declared_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) of the canonical links and immediate redirects that pages declare with an absolute address."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)(<link\b[^>]*\brel=["']?canonical\b[^>]*>|<meta\b[^>]*http-equiv=["']?refresh\b[^>]*>)"""), F.lit(1))
    tagged = pages.select(F.col(url).alias("source"), F.explode(tags).alias("tag"))
    target = F.regexp_extract("tag", r"""(?i)(?:href=|url=)["']?\s*([a-z][a-z0-9+.-]*://[^\s"'>]+)""", 1)
    return tagged.select("source", target.alias("target")).where("source IS NOT NULL AND target <> ''").distinct()


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, verdict) for each row of ``urls``, from rules (host, path, verdict).

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest one wins, a block
    if an allow is as long. Rules meet hosts in an equi-join on the host's endings, over distinct hosts only, so a host
    with many pages is looked up once.
    """
    split = urls.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = rules.select(
        F.col("host").alias("_ending"), (-F.length(F.concat("host", "path"))).alias("rank"), F.col("verdict").alias("way"),
        F.col("path").alias("begin"), F.concat("host", "path").alias("rule"),
    ).where("_ending IS NOT NULL AND begin IS NOT NULL AND way IS NOT NULL")
    hosts = split.select("host").where("host <> ''").distinct().select(F.col("host").alias("_host"), F.explode(endings).alias("_ending"))
    fitting = hosts.join(named, "_ending").groupBy("_host").agg(F.array_sort(F.collect_set(F.struct("rank", F.expr("way = 'allow'").alias("soft"), "begin", "rule", "way"))).alias("fits"))
    joined = split.join(fitting, F.col("host") == F.col("_host"), "left")
    first = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["begin"])), F.lit(0))
    return joined.withColumn("_rule", first).select(*split.columns, F.col("_rule.rule").alias("rule"), F.col("_rule.way").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``; ``links`` are (source, target) URLs.

    A URL with a rule has the rule's verdict. Any other takes that of its component: allow if a member is allowed by a
    rule, else block if a member is blocked by one, else allow. Components join URLs over ``links`` and over each URL's
    implied canonical form.

    Null URLs and those without ``://`` have empty host and path, no rule, no aliases, and are allowed. Repeated rows
    and URLs are judged alike; rows without an id come back too; null ends of links are ignored; empty tables are fine;
    other columns are ignored. A URL of any share of the rows is one node.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    own = durable(matched_rules(rows, rules))
    ends = links.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    seen = own.where("host <> ''").select("url").union(ends.select("a")).union(ends.select("b")).distinct()
    implied = seen.select(F.concat(F.lit("url:"), F.col("url")).alias("a"), F.concat(F.lit("form:"), canonical(F.col("url"))).alias("b")).where("b IS NOT NULL")
    implied = durable(implied)
    # A form that a single URL implies and no link touches joins nothing: it needs no part in the star steps.
    several = implied.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
    linked = ends.select(F.concat(F.lit("url:"), F.col("a")).alias("a"), F.concat(F.lit("url:"), F.col("b")).alias("b"))
    touched = linked.select("a").union(linked.select("b")).distinct()
    edges = implied.join(several, "b", "left_semi").select("a", "b").union(implied.join(touched, "a", "left_semi").select("a", "b")).union(linked)
    components = durable(connected_components(edges, "a", "b"))

    outside = matched_rules(ends.select(F.col("b").alias("url")).union(ends.select("a")).distinct(), rules)  # aliases without a page
    ruled = own.select("url", "verdict").union(outside.select("url", "verdict")).where("verdict IS NOT NULL").distinct()
    ruled = ruled.select(F.concat(F.lit("url:"), F.col("url")).alias("node"), "verdict").join(components, "node")
    decided = ruled.groupBy("component").agg(F.min("verdict").alias("passed_on"))  # "allow" sorts before "block"
    passed = components.join(decided, "component").select(F.col("node").alias("_node"), "passed_on")
    bare = own.where("rule IS NULL").join(passed, F.concat(F.lit("url:"), F.col("url")) == F.col("_node"), "left")
    bare = bare.select("page_id", "host", "path", "rule", F.coalesce("passed_on", F.lit("allow")).alias("verdict"))
    return own.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", "verdict").union(bare)
