"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.runtime import durable

# The whitespace and the word characters of the two tokenisations, as regular expressions.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; a text without such letters is returned as it is."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores in front as no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def n_plain_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hashes of the words seen lately; emptied when it grows beyond a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another node.

    Alternates the large-star and small-star steps until the edges no longer change; every step is a grouped minimum
    and a join, so no node's neighbours are ever gathered, and lineage is cut in the shared folder. Null ends and loops
    are ignored; nodes without edges don't appear.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    pairs = durable(edges.where(f"{a} IS NOT NULL AND {b} IS NOT NULL").select(high.alias("u"), low.alias("v")).where("u != v").distinct())
    state = None
    while True:
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = durable(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
