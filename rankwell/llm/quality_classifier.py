"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Each word has a sparse random index vector. A word's context vector is the sum of its neighbours' index vectors over the
whole corpus; sums are whole numbers, so they don't depend on the order of the rows. Words share a fixed number of
hashed slots, which bounds the table whatever the vocabulary. A document is the mean and spread of its words' unit
vectors; a two-layer network scores it, and a temperature fitted to rows it has not learned from calibrates it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS, WIDTH, BLOCKS = 1 << 14, 32, 256
REACH = 2  # neighbours on each side
PIECE = 200_000  # words that are summed at a time
TOKEN = re.compile(r"\w+|[^\w\s]")
N_FEATURES = 2 * WIDTH + 1


def index_vectors(seed: int = 11) -> np.ndarray:
    """One row per slot, with two 1s and two -1s."""
    rng = np.random.default_rng(seed)
    places = rng.random((SLOTS, WIDTH)).argsort(axis=1)[:, :4]
    out = np.zeros((SLOTS, WIDTH), np.int64)
    np.put_along_axis(out, places, np.array([1, 1, -1, -1]), axis=1)
    return out


class Slots(dict):
    """Slots of the words seen lately; emptied when it grows beyond a bound."""

    def __missing__(self, word: str) -> int:
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
        return value

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        words = TOKEN.findall(text) if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def add_contexts(table: np.ndarray, slots: np.ndarray, index: np.ndarray) -> None:
    """Adds the neighbours' index vectors to the rows of a document's words."""
    for at in range(0, len(slots), PIECE):
        own = slots[at : at + PIECE]
        sums = np.zeros((len(own), WIDTH), np.int64)
        for d in range(1, REACH + 1):
            left, right = slots[max(0, at - d) : max(0, at + len(own) - d)], slots[at + d : at + d + len(own)]
            sums[len(own) - len(left) :] += index[left]
            sums[: len(right)] += index[right]
        order = own.argsort(kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        table[own[order][first]] += np.add.reduceat(sums[order], first, axis=0)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, index, slots = np.zeros((SLOTS, WIDTH), np.int64), index_vectors(), Slots()
    for batch in batches:
        held, size = [], 0
        for text in batch.column("text").to_pylist():
            # Texts are strung together, apart by more than the reach, so that short ones share the cost of a step.
            held.append(slots.of(text))
            size += len(held[-1])
            if size >= PIECE:
                _flush(table, held, index)
                held, size = [], 0
        _flush(table, held, index)
    yield _blocks(table)


def _flush(table: np.ndarray, held: list[np.ndarray], index: np.ndarray) -> None:
    """One extra slot, with an empty index vector, stands between texts; what it gathers is dropped."""
    if not held:
        return
    gap = np.full(REACH, SLOTS, np.int64)
    wide, padded = np.zeros((SLOTS + 1, WIDTH), np.int64), np.vstack([index, np.zeros((1, WIDTH), np.int64)])
    add_contexts(wide, np.concatenate([x for h in held for x in (h, gap)]), padded)
    table += wide[:SLOTS]


def _blocks(table: np.ndarray) -> pa.RecordBatch:
    parts = [b.tobytes() for b in np.split(table, BLOCKS)]
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            part = np.frombuffer(data.as_buffer(), np.int64)
            sums[block] = sums[block] + part if block in sums else part.copy()
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors of all slots, from all texts. What reaches the driver has a fixed size (4 MB)."""
    schema = "block int, sums binary"
    parts = docs.select(F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(_gather, schema)
    rows = parts.repartition("block").mapInArrow(_add, schema).collect()
    table = np.zeros((BLOCKS, SLOTS // BLOCKS * WIDTH), np.int64)
    for row in rows:
        table[row["block"]] += np.frombuffer(row["sums"], np.int64)
    table = table.reshape(SLOTS, WIDTH).astype(np.float64)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors, and the logarithm of their number; zeros without words."""
    out = np.zeros(N_FEATURES)
    if len(slots):
        counts = np.bincount(slots, minlength=SLOTS)
        used = np.flatnonzero(counts)
        share, rows = counts[used] / len(slots), vectors[used].astype(np.float64)
        mean = share @ rows
        out[:WIDTH], out[WIDTH:-1], out[-1] = mean, np.sqrt(np.maximum(share @ rows**2 - mean**2, 0)), np.log1p(len(slots))
    return out


@dataclass(frozen=True)
class Network:
    """Two layers on standardised inputs; ``temperature`` divides the last layer's output."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.center) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the log loss over five sixths of the rows; the others give the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    tune, fit = order[: len(y) // 6], order[len(y) // 6 :]
    center, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z = (x - center) / scale
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        shuffled = rng.permutation(fit)
        for at in range(0, len(fit), batch):
            rows = shuffled[at : at + batch]
            h = np.maximum(z[rows] @ w[0] + w[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[rows]) / len(rows)
            dh = np.outer(d, w[2]) * (h > 0)
            t += 1
            for i, g in enumerate([z[rows].T @ dh + decay * w[0], dh.sum(axis=0), h.T @ d + decay * w[2], np.array([d.sum()])]):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(center, scale, w[0], w[1], w[2], float(w[3][0]))
    if not len(tune):
        return net
    raw = net.logits(x[tune])
    loss = lambda temp: np.mean(np.logaddexp(0, np.where(y[tune] > 0.5, -raw, raw) / temp))
    grid = np.geomspace(0.25, 16, 121)
    return Network(center, scale, w[0], w[1], w[2], float(w[3][0]), float(grid[np.argmin([loss(g) for g in grid])]))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, doc_id: str = "doc_id", text: str = "text", target: str = "quality", sample: int = 20_000) -> Network | None:
    """A network from at most ``sample`` rows of ``labels``, those with the smallest hash of their id.

    Repeated labels of an id count once; rows without id or label aren't used. None without any row.
    """
    chosen = labels.where(F.col(doc_id).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(target).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            x = [pooled(slots.of(t), vectors) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    found = rows.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "y int, x array<double>").toPandas()
    if not len(found):
        return None
    x, y = np.array(found["x"].tolist()), found["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the result then doesn't depend on the order of arrival
    return fit_network(x[order], y[order])


def score(docs: DataFrame, vectors: np.ndarray, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``: the probability that the whole text is good; 0.5 without a network.

    Null and empty texts are scored as a document without words. Rows are scored one by one: repeated rows get equal
    scores, rows without an id come back too, an empty table stays empty, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            x = np.array([pooled(slots.of(t), vectors) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            scores = network.probability(x) if network is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
