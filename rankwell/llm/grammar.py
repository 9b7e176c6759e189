"""Recompression: a run-length grammar of a sequence, and longest common extensions answered by it.

Levels alternate: one replaces each block of equal symbols by one symbol, the next replaces pairs of a left and a right
symbol, by a division of the symbols that covers at least a fifth of the neighbours. Equal symbols of a level spell
equal stretches, so two suffixes are compared by climbing while symbols agree and descending where they differ. All
queries of a call take their steps together.
"""

from __future__ import annotations

from itertools import count

import numpy as np


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, from 0."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _sides(symbols: np.ndarray) -> np.ndarray:
    """Whether each symbol is a left one; neighbours differ. Some seed covers a quarter of them on average."""
    need = (len(symbols) - 1) / 5
    for seed in count(1):
        mixed = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        left = (mixed >> np.uint64(63)).astype(bool)
        for side in (left, ~left):
            if np.count_nonzero(side[:-1] & ~side[1:]) >= need:
                return side
    raise AssertionError("unreachable")


class Grammar:
    """Grammar of ``word`` (numbers from 0). Each level keeps its symbols and where they begin on the level below.

    ``extend(x, y)`` gives, for pairs of places, the length of the longest common prefix of the suffixes there.
    """

    def __init__(self, word: np.ndarray):
        # A last symbol of its own ends every extension.
        symbols = np.append(word, int(word.max(initial=0)) + 1).astype(np.int64)
        self.symbols: list[np.ndarray] = [symbols]
        self.starts: list[np.ndarray] = []  # of the next level's symbols on this level
        self.up: list[np.ndarray] = []  # the next level's symbol over each symbol
        self.left: list[np.ndarray] = []  # symbols of the same block from this one on; 1 on levels that make pairs
        blocks = True
        while len(symbols) > 1:
            if blocks:
                begins = np.append(True, symbols[1:] != symbols[:-1])
            else:
                side = _sides(symbols)
                begins = ~np.append(False, side[:-1] & ~side[1:])
            starts = np.flatnonzero(begins)
            width = np.diff(np.append(starts, len(symbols)))
            up = np.cumsum(begins) - 1
            self.starts.append(starts)
            self.up.append(up)
            self.left.append(starts[up] + width[up] - np.arange(len(symbols)) if blocks else np.ones(len(symbols), np.int64))
            second = width if blocks else np.where(width > 1, symbols[np.minimum(starts + 1, len(symbols) - 1)] + 1, 0)
            symbols = _names(symbols[starts], second)
            self.symbols.append(symbols)
            blocks = not blocks

    def extend(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places must differ within a pair."""
        x0, x, y = x, x.astype(np.int64), y.astype(np.int64)  # copies
        level = np.full(len(x), -1)  # where the symbols differ
        live = np.arange(len(x))
        top = len(self.starts)
        for t in range(top):
            if not len(live):
                break
            s, up, left, starts = self.symbols[t], self.up[t], self.left[t], self.starts[t]
            # To reach the border of a symbol above: the rest of a block, or the second half of a pair.
            for _ in range(1 if t % 2 == 0 else 2):
                inside = np.flatnonzero((starts[up[x[live]]] != x[live]) | (starts[up[y[live]]] != y[live]))
                at = live[inside]
                n = np.minimum(left[x[at]], left[y[at]])
                same = s[x[at]] == s[y[at]]
                step = np.where(same, n, 0)
                # A block that is longer on one side ends the extension after the shorter one.
                x[at], y[at] = x[at] + step, y[at] + step
                level[at[~same]] = t
                live = live[level[live] < 0]
            differ = s[x[live]] != s[y[live]]
            level[live[differ]] = t
            live = live[~differ]
            x[live], y[live] = up[x[live]], up[y[live]]
        level[live] = top
        for t in range(min(top, int(level.max(initial=0))), -1, -1):
            now = np.flatnonzero(level >= t)
            s = self.symbols[t]
            if t < top:  # those that come from above begin a symbol; equal first symbols are passed
                left = self.left[t]
                for _ in range(2):
                    at = now[s[x[now]] == s[y[now]]]
                    step = np.minimum(left[x[at]], left[y[at]])
                    x[at], y[at] = x[at] + step, y[at] + step
            if t:
                x[now], y[now] = self.starts[t - 1][x[now]], self.starts[t - 1][y[now]]
        return x - x0
