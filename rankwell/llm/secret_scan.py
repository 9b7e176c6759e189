r"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the digest of its content. The ledger holds, per blob, which rules at which
version have scanned it and what they found; a run scans only what the ledger lacks, appends it, and joins the findings
back to all paths that ever held the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import free_name
from rankwell.runtime import checkpoint_dir, durable, small_side

FINDINGS = "array<struct<rule:string, version:int, start:int, stop:int>>"
LEDGER_SCHEMA = f"blob binary, rules array<string>, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are secrets if ``group`` of them is at least ``least`` characters long."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
# A key runs to its END line; without one, over what follows of base64: long runs, and short ones that fill a line.
_LABEL = r"(?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
_EOL = r"(?:\r?\n|\r(?!\n)|\\r\\n|\\n)"
_TO_END = rf"[^-]*(?:-{{1,4}}(?!-)[^-]*)*-----END {_LABEL}"
_HEADERS = rf"(?:{_EOL}[\x20\t>]*[A-Za-z][A-Za-z0-9-]{{1,30}}:\x20[^\r\n\\]*)*"
_BODY = rf"(?:(?:{_EOL}|[\x20\t>])+[A-Za-z0-9+/]{{16,}}={{0,2}}|{_EOL}[\x20\t>]*[A-Za-z0-9+/]{{1,15}}={{0,2}}(?=[\x20\t]*(?:{_EOL}|\Z)))*"
MORE_RULES = (
    Rule("private_key", 2, rf"-----BEGIN {_LABEL}(?:{_TO_END}|{_HEADERS}{_BODY})"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("host_token", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
    Rule("url_login", 2, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES


def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | re.IGNORECASE if rule.any_case else re.ASCII)


def find(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches that are long enough, as (kind, start, stop) in code points."""
    return [(rule.kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    @F.pandas_udf(FINDINGS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        patterns = {r.name: (r, _compiled(r)) for r in rules}
        for texts, missing in batches:
            yield pd.Series([
                [{"rule": k, "version": patterns[name][0].version, "start": a, "stop": b} for name in names for k, a, b in find(text, *patterns[name])]
                for text, names in zip(texts, missing, strict=True)
            ], dtype=object)

    return run


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _update(versions: DataFrame, ledger_path: str, text: str, path: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """Brings the ledger up to date; the (path, blob) index and the (blob, findings) of blobs with any."""
    spark = versions.sparkSession
    rows = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    names = F.array(*[F.lit(r.name) for r in rules])
    index = durable(rows.select("path", "blob"))
    held = index.groupBy("blob").agg(F.min("path").alias("at"), F.count(F.lit(1)).alias("copies"))
    ledger = read_ledger(spark, ledger_path)
    seen = ledger.select("blob", F.explode("rules").alias("r")).where(F.col("r").isin([r.name for r in rules]))
    seen = seen.groupBy("blob").agg(F.collect_set("r").alias("seen"))  # at most one entry per current rule

    # A first run has few blobs that need not be scanned where they stand, a later one few that still need it: the rarer
    # side meets the rows, so that no text is shuffled while that side is small.
    missing = F.when(F.col("seen").isNull(), names).otherwise(F.array_except(names, F.col("seen")))
    held = durable(held.join(seen, "blob", "left").select("blob", "at", "copies", missing.alias("rules"), (F.col("copies") > 1) | F.col("seen").isNotNull()).toDF("blob", "at", "copies", "rules", "special"))
    special, pending = held.where("special").select("blob", "at", "rules"), held.where("size(rules) > 0").select("blob", "at", "rules")
    n_special, n_pending = held.agg(F.count_if("special"), F.count_if(F.size("rules") > 0)).first()
    if n_special <= n_pending:
        todo = rows.join(small_side(special), "blob", "left").withColumn("rules", F.coalesce("rules", names))
    else:
        todo = rows.join(small_side(pending), "blob")
    todo = todo.where("(at IS NULL OR path = at) AND size(rules) > 0").select("blob", "content", "rules")
    if n_pending:
        todo.select("blob", "rules", _scan(rules)("content", "rules").alias("findings")).write.mode("append").parquet(ledger_path)

    found = read_ledger(spark, ledger_path).where("size(findings) > 0").select("blob", F.explode("findings").alias("f"))
    found = found.where(F.concat_ws("@", "f.rule", "f.version").isin([r.name for r in rules]))
    found = found.join(held.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.collect_set("f").alias("findings"))
    return index, found


def scan(versions: DataFrame, ledger_path: str, text: str = "text", path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, findings) for each row of ``versions``: all findings of the current rules in the row's content.

    Only pairs of a blob and a rule version that the ledger at ``ledger_path`` lacks are scanned; they are appended in
    one committed write, so a run that fails leaves the ledger as it was. A blob that several rows hold is scanned
    where its smallest path stands; rows of equal path may scan it again, with the same findings.

    Whole texts are scanned. Null counts as empty text, which has no findings. Rows without a path come back too,
    repeated rows as often as they are given; an empty table gives an empty result; other columns are ignored.
    """
    index, found = _update(versions, ledger_path, text, path, rules)
    return index.join(found, "blob", "left").select("path", "blob", F.coalesce("findings", F.expr(f"cast(array() AS {FINDINGS})")).alias("findings"))


def ledger_of(spark: SparkSession, table_path: str) -> str:
    """The ledger that goes with a table: a folder in the shared location that stays from run to run."""
    name = hashlib.sha256(table_path.rstrip("/").encode()).hexdigest()[:32]
    return f"{checkpoint_dir(spark).rstrip('/')}/ledger-{name}"


def read_ledger(spark, ledger_path: str) -> DataFrame:
    """The ledger so far; empty if nothing has been written there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)


def listed(findings: str, kinds: tuple[str, ...]) -> Column:
    """The findings of some kinds as kind:start:stop, by start, then by the order of kinds, joined by commas."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(F.filter(findings, lambda f: F.array_contains(order, f["rule"])), lambda f: F.struct(f["start"].alias("a"), F.array_position(order, f["rule"]).alias("k"), f["stop"].alias("z"), f["rule"].alias("r")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda f: F.concat_ws(":", f["r"], f["a"], f["z"])), ",")


def _masked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, findings in batches:
        out = []
        for text, spans in zip(texts, findings, strict=True):
            parts, at = [], 0
            for span in sorted(spans if text is not None else [], key=lambda f: (f["start"], -f["stop"])):
                if span["start"] >= at:
                    parts += [text[at : span["start"]], f"[{span['rule']}]"]
                at = max(at, span["stop"])
            out.append(None if text is None else "".join([*parts, text[at:]]))
        yield pd.Series(out, dtype=object)


def redact(docs: DataFrame, ledger_path: str, text: str = "text", path: str = "doc_id", rules: tuple[Rule, ...] = RULES, n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every finding replaced by its ``[kind]``, findings that overlap by that of the first.

    All rows and columns stay, whatever the columns are called. The column ``n_chars``, if there is one, is counted anew in the rows that change. Null
    and empty texts stay as they are, repeated rows change alike, an empty table stays empty.
    """
    _, found = _update(docs, ledger_path, text, path, rules)
    key, blob, findings, new = (free_name(docs.columns, n) for n in ("_key", "_blob", "_findings", "_new"))
    found = found.select(F.col("blob").alias(blob), F.col("findings").alias(findings))
    joined = docs.withColumn(key, blob_of(F.col(text))).join(small_side(found), F.col(key) == F.col(blob), "left")
    changed = joined.withColumn(new, F.pandas_udf(_masked, "string")(F.when(F.col(findings).isNotNull(), F.col(text)), F.col(findings)))
    if n_chars in docs.columns:
        length = F.length(new).cast(docs.schema[n_chars].dataType)
        changed = changed.withColumn(n_chars, F.when(F.col(new).isNotNull(), length).otherwise(F.col(n_chars)))
    return changed.withColumn(text, F.coalesce(new, text)).select(*[f"`{c}`" for c in docs.columns])
