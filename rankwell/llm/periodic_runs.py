"""Runs of repeated words, found by recompression.

For each period, places at its multiples are the candidates; in a run of four periods four of them in a row hold equal
words. How far the period goes on from there to both sides is asked of two run-length grammars, of the words and of the
words in reverse. No suffix arrays, no comparison of stretches word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.bpe import chunks
from rankwell.llm.grammar import Grammar

EXPONENT, LEAST = 4, 6
SCHEMA = "runs array<struct<start: bigint, length: bigint, period: bigint>>, n_words bigint, collapsed string"
BLOCK = 1 << 20  # candidates looked at together


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) for all multiples of each period whose next EXPONENT - 1 multiples lie within n words, in blocks."""
    periods = np.arange(1, (n - 1) // (EXPONENT - 1) + 1)
    sizes = (n - 1 - (EXPONENT - 1) * periods) // periods + 1
    at = 0
    while at < len(periods):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK, "right")) + at)
        q = np.repeat(periods[at:stop], sizes[at:stop])
        k = np.arange(len(q)) - np.repeat(np.cumsum(sizes[at:stop]) - sizes[at:stop], sizes[at:stop])
        yield k * q, q
        at = stop


def candidates(word: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the harmonic grids of all texts at which EXPONENT words, a period apart, are equal."""
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Short texts of one length share a grid and are looked at together.
    for n in np.unique(sizes[sizes >= LEAST]):
        texts = starts[sizes == n]
        for at, q in _grid(int(n)):
            step = max(1, BLOCK // len(at))
            for k in range(0, len(texts), step):
                i = (texts[k : k + step, None] + at[None, :]).ravel()
                period = np.tile(q, len(i) // len(q))
                for m in range(1, EXPONENT):
                    same = word[i + (m - 1) * period] == word[i + m * period]
                    i, period = i[same], period[same]
                places.append(i)
                periods.append(period)
    return np.concatenate(places), np.concatenate(periods)


def find(word: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of texts that stand one after the other in ``word``: rows (start, length, period), sorted by start, period.

    After each text stands a word of its own. A stretch whose smallest period is q is found under multiples of q as
    well, always with the same ends, of which the smallest counts.
    """
    at, period = candidates(word, starts, sizes)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    # Only texts with a candidate need a grammar.
    text = np.unique(np.searchsorted(starts, at, "right") - 1)
    size = sizes[text] + 1
    offset = np.cumsum(size) - size
    kept = np.repeat(starts[text] - offset, size) + np.arange(size.sum())
    moved = at - np.repeat(starts[text] - offset, size)[np.searchsorted(kept, at)]
    own = np.unique(word[kept], return_inverse=True)[1]
    n = len(own)
    forward, backward = Grammar(own), Grammar(own[::-1])
    found = [np.zeros((0, 3), np.int64)]
    for k in range(0, len(at), BLOCK):
        i, q = moved[k : k + BLOCK], period[k : k + BLOCK]
        stop = i + q + forward.extend(i, i + q)
        # The word before place p is number n - p of the reversed words; place 0 has none.
        back = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        back[inner] = backward.extend(n - i[inner], n - i[inner] - q[inner])
        rows = np.column_stack([i - back, stop - i + back, q])
        found.append(np.unique(rows[rows[:, 1] >= np.maximum(LEAST, EXPONENT * q)], axis=0))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows
    rows[:, 0] = kept[rows[:, 0]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[str]) -> list[tuple[list[tuple[int, int, int]], int, str]]:
    """For each text its runs, its number of words, and the words that are kept, joined by blanks."""
    out = []
    for group in chunks(texts):
        words, starts, sizes, ids = [], [], [], {}
        codes: list[int] = []
        for n in group:
            own = texts[n].encode().split()
            starts.append(len(codes))
            sizes.append(len(own))
            words.append(own)
            codes += [ids.setdefault(w, len(ids)) for w in own]
            codes.append(ids.setdefault(n, len(ids)))  # no word, so nothing goes on beyond a text
        starts, sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        rows = find(np.array(codes, np.int64), starts, sizes)
        edges = np.searchsorted(rows[:, 0], np.append(starts, len(codes)))
        for k, own in enumerate(words):
            mine = rows[edges[k] : edges[k + 1]] - [starts[k], 0, 0]
            if len(mine):
                change = np.zeros(len(own) + 1, np.int64)
                np.add.at(change, mine[:, 0] + mine[:, 2], 1)
                np.add.at(change, mine[:, 0] + mine[:, 1], -1)
                own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            out.append((list(map(tuple, mine.tolist())), int(sizes[k]), b" ".join(own).decode()))
    return out


def find_runs(docs: DataFrame, text: str = "text", into: str = "_runs") -> DataFrame:
    """``docs`` with a struct column ``into``: runs, n_words and collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q and at least
    max(6, 4 q) words that no neighbouring word extends keeping q; ``runs`` has start, length and period of all of them, by
    start, then period. ``collapsed`` is the text's words joined by one blank, without those that a run contains after its
    first q words. Null and empty texts have no runs and collapse to ''. Rows are looked at one by one and whole: repeated
    rows get equal results, an empty table stays empty, other columns pass through.
    """

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = runs_of([t or "" for t in texts])
            yield pd.DataFrame({
                "runs": pd.Series([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs, _, _ in rows], dtype=object),
                "n_words": np.array([n for _, n, _ in rows], np.int64), "collapsed": pd.Series([c for _, _, c in rows], dtype=object),
            })

    # Not to be copied into the expressions that use its fields.
    return docs.withColumn(into, run.asNondeterministic()(F.col(text)))
