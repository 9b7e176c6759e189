"""Input tables, mapped views and the query registry.

A mapped view turns the driver's star schema into one of the engine's own entities (chunks, weights,
rankings, ...). Its text is written in the SQL both Spark and the oracle understand, so both sides of a
check start from the same rows; what is under test is the operator applied to them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankwell.runtime import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables whose rows take long to process one by one.
SPREAD = ("documents", "orders", "customer")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEWS: dict[str, tuple[str, str]] = {}

_REF = re.compile(r"\{([a-z]\w*)\}")


def view(name: str, shared: str | None = None, *, spark: str | None = None, oracle: str | None = None) -> None:
    """Declare a mapped view; ``{name}`` refers to a table or another view."""
    _VIEWS[name] = (spark or shared, oracle or shared)


class Tables:
    """Lazy access to the parquet tables and mapped views of one dataset folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view(name)

    def view(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in _VIEWS:
                df = self.sql(_VIEWS[name][0])
            else:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                if name in SPREAD:
                    df = spread(df)
            self._seen[name] = df
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        refs = {ref: self.view(ref) for ref in _REF.findall(text)}
        literal = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(re.sub(r"\{\{([a-z]\w*)\}\}", r"{\1}", literal), **refs)


def _needed(names: list[str], out: list[str]) -> list[str]:
    for name in names:
        if name in _VIEWS and name not in out:
            _needed(_REF.findall(_VIEWS[name][1]), out)
            out.append(name)
    return out


def oracle_query(text: str) -> str:
    """Expand ``{view}`` references in an oracle statement into a leading WITH clause."""
    names = _needed(_REF.findall(text), [])
    ctes = [f"{n} AS ({_REF.sub(r'\1', _VIEWS[n][1])})" for n in names]
    body = _REF.sub(r"\1", text).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under an operator key, with its oracle statement."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
