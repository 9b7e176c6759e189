"""Quality rules: gradient-boosted trees over document statistics, scored as flat node arrays.

The statistics of each text are counted exactly; a small ensemble of monotonic trees, fitted to labelled rows, turns
them into the probability that a text is good.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import free_name

SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_marks", "n_lines"]
COUNTS_SCHEMA = ", ".join(f"{c} bigint" for c in COUNTS)
UPPER, MARKS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[!?]")

# The trees' inputs, with the direction in which a larger value may move the score: 1 up, -1 down, 0 either way.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1,
    "distinct_rate": 0, "upper_rate": -1, "mark_rate": -1, "line_words": 0,
}


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(n, bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


# Splitting on the blanks that the byte-string method uses keeps other Unicode blanks inside words.
_BLANK = re.compile("[\x20\x09-\x0d]+")


def document_counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    words = [w for w in _BLANK.split(text) if w]
    lines = [line for line in text.split("\n") if _BLANK.sub("", line)]
    return (
        len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words),
        len(set(words)), len(UPPER.findall(text)), len(MARKS.findall(text)), len(lines),
    )


def features(counts: pd.DataFrame) -> np.ndarray:
    """One row per document and one column per entry of FEATURES."""
    c = {k: counts[k].to_numpy(np.float64) for k in COUNTS}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_distinct_words"] / words, c["n_upper"] / np.maximum(c["word_chars"], 1), c["n_marks"] / words, c["n_words"] / lines,
    ])


def base_failed(counts: pd.DataFrame) -> pd.Series:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays; a leaf points to itself, so every row takes the same number of steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    prior: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))[:, None]
        for at in range(0, len(self.roots), 32):
            node = np.repeat(self.roots[None, at : at + 32], len(x), axis=0)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Boosted trees for a 0/1 target by histograms of the logistic loss.

    A constrained feature splits only if its two sides are in order; each side then keeps to its half of the range of
    values, so that deeper splits cannot undo the order.
    """
    signs = list(FEATURES.values())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    cell = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])])
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(rate_of / (1 - rate_of)))
    score = np.full(len(y), prior)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        weight = lambda gs, hs: np.clip(-gs / (hs + l2), low, high)
        gain_of = lambda gs, hs, w: -(gs * w + 0.5 * (hs + l2) * w * w)
        own = weight(g[rows].sum(), h[rows].sum())
        nodes.append([0, np.inf, at, at, float(own) * rate])
        best = (1e-6, -1, 0, 0.0, 0.0)
        base = gain_of(g[rows].sum(), h[rows].sum(), own)
        if level < depth and len(rows) >= 2 * least:
            for j, cut in enumerate(cuts):
                size = len(cut) + 1
                gs = np.bincount(cell[rows, j], g[rows], size).cumsum()
                hs = np.bincount(cell[rows, j], h[rows], size).cumsum()
                ns = np.bincount(cell[rows, j], minlength=size).cumsum()
                lw, rw = weight(gs[:-1], hs[:-1]), weight(gs[-1] - gs[:-1], hs[-1] - hs[:-1])
                gain = gain_of(gs[:-1], hs[:-1], lw) + gain_of(gs[-1] - gs[:-1], hs[-1] - hs[:-1], rw) - base
                fits = (ns[:-1] >= least) & (ns[-1] - ns[:-1] >= least) & (signs[j] * (rw - lw) >= 0)
                gain = np.where(fits, gain, -np.inf)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], j, k, lw[k], rw[k])
        _, j, k, lw, rw = best
        if j >= 0:
            middle = (lw + rw) / 2
            goes = cell[rows, j] <= k
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
            left = grow(rows[goes], g, h, level + 1, *bounds[0])
            right = grow(rows[~goes], g, h, level + 1, *bounds[1])
            nodes[at][:4] = [j, float(cuts[j][k]), left, right]
        return at

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        f, t, lt, rt, v = (np.array(c) for c in zip(*nodes))
        node = np.full(len(y), roots[-1])
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), f[node]] <= t[node], lt[node], rt[node])
        score += v[node]
    f, t, lt, rt, v = (np.array(c) for c in zip(*nodes)) if nodes else (np.zeros(1, int), np.full(1, np.inf), np.zeros(1, int), np.zeros(1, int), np.zeros(1))
    return Trees(np.array(roots, int), f.astype(int), t.astype(float), lt.astype(int), rt.astype(int), v.astype(float), prior, depth)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: str = "quality", sample: int = 20_000) -> Trees | None:
    """Trees fitted to at most ``sample`` labelled rows, those with the smallest hash of their id.

    Repeated labels of an id count once, with the larger one; rows without an id or a label aren't used. None if no row
    is left: then only the base rules judge.
    """
    chosen = labels.where(F.col(doc_id).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(target).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_y", _counts("_text").alias("c"))
    found = rows.select("_y", "c.*").toPandas()
    found = found.sort_values(list(found.columns), kind="stable")  # sums then don't depend on the order of arrival
    return fit_trees(features(found), found["_y"].to_numpy(np.float64)) if len(found) else None


def _counts(text: str):
    @F.pandas_udf(COUNTS_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([document_counts(t) for t in texts], columns=COUNTS)

    return run(F.col(text))


def judge(docs: DataFrame, trees: Trees | None, text: str = "text", into: str = "_quality", threshold: float = 0.5) -> DataFrame:
    """``docs`` with a struct column ``into``: the counts, base_failed, score and kept.

    ``kept`` is false where a base rule fails (fewer than 50 words, or over half of the words in repeated three-word
    windows), else whether the trees' score reaches ``threshold``. Null and empty texts count zero throughout and fail.
    Rows are judged one by one: repeated rows get equal verdicts, an empty table stays empty, other columns pass through.
    """

    @F.pandas_udf(f"{COUNTS_SCHEMA}, base_failed boolean, score double, kept boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([document_counts(t) for t in texts], columns=COUNTS)
            out["base_failed"] = base_failed(out)
            out["score"] = trees.probability(features(out)) if trees is not None else 1.0
            out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
            yield out

    return docs.withColumn(into, run(F.col(text)))


def keep_good(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns, whatever those are called."""
    verdict = free_name(docs.columns, "_quality")
    return judge(docs, trees, text, into=verdict).where(F.col(verdict)["kept"]).drop(verdict)
