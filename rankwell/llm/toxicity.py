"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they catch.

The lexicon holds word stems. A word is caught if it begins with a stem, or if it is as a whole within a few edits of
one. Trie and edit automata are walked as one machine, whose states are built when first met, so that a word costs one
step per letter until nothing can match. Each catch is scored in its window: quotation and reported speech weigh less
than words aimed at someone. A logistic model over the window scores gives the probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORTING = frozenset("said says called calls wrote quoted quote quoting reported dit écrit dijo dice sagte sagt".split())
ADDRESSING = frozenset("you your youre u tu te vous votre eres usted du dich dein sie".split())
QUOTES = "\"“”„«»"
WORD = re.compile(r"[^\W_]+")
WINDOW = 6  # words on each side of a catch
N_FEATURES = 7


def allowed_edits(stem: str) -> int:
    return 0 if len(stem) < 5 else 1 if len(stem) < 9 else 2


class Machine:
    """The product of a trie of stems with their Levenshtein automata, made deterministic step by step.

    A state maps trie nodes to the fewest edits with which they can be reached. ``match`` returns 0 for a word that
    begins with a stem, the number of edits for one that resembles a stem, and None.
    """

    LIMIT = 200_000  # states and words that are remembered

    def __init__(self, stems: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.edits = [0]  # the most edits that a stem below the node allows
        self.ends: list[int | None] = [None]  # those of the stem that ends here
        for stem in stems:
            node, most = 0, allowed_edits(stem)
            self.edits[0] = max(self.edits[0], most)
            for letter in stem:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.edits.append(0)
                    self.ends.append(None)
                node = self.children[node][letter]
                self.edits[node] = max(self.edits[node], most)
            self.ends[node] = most
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.final: list[int | None] = []
        self.steps: list[dict[str, int]] = []
        self.words: dict[str, int | None] = {}
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With what is reached by leaving letters of the stem out."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.edits[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            found = [e for node, e in nodes.items() if self.ends[node] is not None and e <= self.ends[node]]
            self.final.append(min(found, default=None))
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[state].items():
            if e + 1 <= self.edits[node]:
                reached[node] = min(reached.get(node, 99), e + 1)  # a letter too many
            for other, child in self.children[node].items():
                f = e + (other != letter)
                if f <= self.edits[child]:
                    reached[child] = min(reached.get(child, 99), f)
        self.steps[state][letter] = to = self._state(self._closed(reached))
        return to

    def _walk(self, word: str) -> int | None:
        state = self.start
        for letter in word:
            to = self.steps[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if self.final[state] == 0:
                return 0
            if not self.sets[state]:
                return None
        return self.final[state]

    def match(self, word: str) -> int | None:
        if word not in self.words:
            if len(self.words) >= self.LIMIT or len(self.sets) >= self.LIMIT:
                self._reset()
            self.words[word] = self._walk(word)
        return self.words[word]


def window_score(words: list[tuple[str, int, int]], i: int, text: str) -> float:
    """How much the catch at word ``i`` sounds like abuse, 0.1 to 1.25: less in quotation marks or reported speech."""
    low, high = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    before, after = text[words[low][1] : words[i][1]], text[words[i][2] : words[high - 1][2]]
    around = [w[0] for w in words[low:i]]
    score = 1.0
    if any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
        score -= 0.6
    if REPORTING.intersection(around):
        score -= 0.3
    if ADDRESSING.intersection(around[-4:]) or ADDRESSING.intersection(w[0] for w in words[i + 1 : i + 5]):
        score += 0.25
    return max(score, 0.1)


def features(text: str | None, machine: Machine) -> list[float]:
    """Window scores of exact and misspelled catches, as sums, maxima and shares; zeros for a text without catches."""
    low = (text or "").lower()
    if not any(machine.match(w) is not None for w in set(WORD.findall(low))):
        return [0.0] * N_FEATURES
    words = [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]
    exact, near = [], []
    for i, (word, _, _) in enumerate(words):
        edits = machine.match(word)
        if edits is not None:
            (near if edits else exact).append(window_score(words, i, low))
    share = 100 / len(words)
    return [np.log1p(sum(exact)), max(exact, default=0), min(sum(exact) * share, 10), np.log1p(sum(near)), max(near, default=0), min(sum(near) * share, 10), float(sum(s < 0.6 for s in exact) > len(exact) / 2)]


@dataclass(frozen=True)
class Model:
    stems: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def learn_stems(texts: DataFrame) -> tuple[str, ...]:
    """Stems of four to nine letters that mark the positive texts among (text, y) rows.

    A beginning of a word is a stem if at least five positive texts have it, almost no other does, and chance doesn't
    explain it. The shortest such beginning counts, lengthened as far as the same texts have it. All of them are kept; their
    number is bounded by the words of the labelled sample.
    """
    words = texts.select("_n", "y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]{4,})"), F.lit(1)))).alias("w"))
    heads = words.select("_n", "y", F.explode(F.expr("transform(sequence(4, least(9, length(w))), n -> substring(w, 1, n))")).alias("head")).distinct()
    counts = heads.groupBy("head").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    sizes = texts.agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("rate")).first()
    rate = min(max(sizes["rate"], 1e-3), 0.999)
    rows = counts.where("pos >= 5 AND pos >= 0.97 * n").collect()
    found = {r["head"]: r["pos"] for r in rows if r["pos"] * -np.log10(rate) >= 6}
    stems: list[str] = []
    for head in sorted(found, key=lambda h: (len(h), h)):
        if any(head[:n] in found for n in range(4, len(head))):
            continue
        while longer := [h for h in found if len(h) == len(head) + 1 and h.startswith(head) and found[h] >= 0.97 * found[head]]:
            head = longer[0]
        stems.append(head)
    return tuple(sorted(stems, key=lambda h: (-found[h], h)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps; the prior pulls the weights towards one for exact and a half for misspelled catches."""
    prior = np.array([1.0, 1.0, 0.0, 0.5, 0.5, 0.0, -0.5])
    a = np.column_stack([x, np.ones(len(x))])
    center = np.append(prior, -3.0)
    w, penalty = center.copy(), np.diag(np.append(np.full(len(prior), l2), 1e-4)) * max(1.0, len(y) ** 0.5)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty @ (w - center)
        w = w - np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + penalty, gradient)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: str = "toxic", sample: int = 24_000) -> Model:
    """Stems and weights from at most ``sample`` rows of ``labels``, those with the smallest hash of their id.

    The weights come from one half, with stems learned from the other half, so that stems found by chance get no undue
    trust; the model's stems then come from both.
    Repeated labels of an id count once; rows without id, label or text aren't used. The lexicon holds learned stems
    alone: without any row it is empty and every text gets the prior's score.
    """
    chosen = labels.where(F.col(doc_id).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(target).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "_id")
    rows = rows.select(F.xxhash64("_id", F.lit(1)).alias("_n"), F.col("y").cast("int").alias("y"), "text")
    half = learn_stems(rows.where("_n % 2 = 0"))
    stems = learn_stems(rows)
    scored = rows.where("_n % 2 <> 0").mapInArrow(_measure(half), "y int, x array<double>").toPandas()
    if not len(scored):
        return Model(stems, *fit_logistic(np.empty((0, N_FEATURES)), np.empty(0)))
    x, y = np.array(scored["x"].tolist()), scored["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])
    return Model(stems, *fit_logistic(x[order], y[order]))


def _measure(stems: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(stems)
        for batch in batches:
            x = [features(t, machine) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(model.stems)
        for batch in batches:
            x = np.array([features(t, machine) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.probability(x))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``: the probability that the whole text is toxic.

    Null and empty texts hold nothing and get the score of a text without catches. Rows are scored one by one: repeated
    rows get equal scores, rows without an id come back too, an empty table stays empty, other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_score(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
