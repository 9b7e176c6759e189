"""Alignment of two tokenizers over the same text by merge paths.

The ends of the tokens of both are two sorted lists of byte offsets. Binary searches along diagonals of their merge path
cut the merging of a batch, whatever the lengths of its documents, into pieces of equal work that know nothing of each
other. A piece emits the pairs of ends that it finds equal; a pair of which one end closes a piece and the other opens
the next one is stitched in afterwards. Equal ends bound the groups and link the two tokens that end there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankwell.llm.bpe import ByteBpe, Encoder, chunks, split

WORK = 1 << 15  # steps of the merge in a piece
GROUP = 400_000  # characters of texts that are aligned together
BATCH = 1000  # rows of an Arrow batch, for queries that write what ``align`` gives
REMEMBERED = 300_000  # pieces of text whose tokens a worker keeps, for each tokenizer
MAX_PAIRS = 2_000_000  # pairs of ids that can be linked at all, up to which their counts are broadcast
FIELDS = ["a_ids", "b_ids", "a_cuts", "b_cuts", "links"]
SCHEMA = "struct<a_ids: array<int>, b_ids: array<int>, a_cuts: array<int>, b_cuts: array<int>, links: array<struct<a_id: int, b_id: int>>>"


def diagonal(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """How many of the first ``steps`` elements of the merge of two sorted lists are from ``a``, whose elements go first
    where both are equal. All binary searches run together."""
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        at = np.where(open_, (low + high) // 2, 0)
        taken = np.zeros(len(at), bool)
        taken[open_] = a[at[open_]] <= b[steps[open_] - 1 - at[open_]]
        low, high = np.where(open_ & taken, at + 1, low), np.where(open_ & ~taken, at, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] = b[j], in order. Both lists ascend without repeats."""
    total = len(a) + len(b)
    steps = np.minimum(np.arange(0, total + work, work), total)
    i = diagonal(a, b, steps)
    j = steps - i
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(steps) - 1):
        mine, other = a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]
        at = np.minimum(np.searchsorted(other, mine), max(len(other) - 1, 0))
        same = np.flatnonzero(other[at] == mine) if len(other) else np.zeros(0, np.int64)
        found_a.append(same + i[k])
        found_b.append(at[same] + j[k])
        # The border: of equal ends the one of a closes this piece and that of b opens the next.
        if 0 < i[k + 1] and j[k + 1] < len(b) and i[k + 1] > i[k] and a[i[k + 1] - 1] == b[j[k + 1]]:
            found_a.append(i[k + 1 : k + 2] - 1)
            found_b.append(j[k + 1 : k + 2])
    return np.concatenate(found_a), np.concatenate(found_b)


class Pieces:
    """The sentence-piece model B, applied to stretches between which no piece reaches.

    Stretches are runs of blanks with what follows up to the next blank, and line ends. No piece of the vocabulary may
    have a blank after another character or a line end beside one; this is checked. Each stretch is encoded once.
    """

    SPLIT = re.compile(r" *[^ \n]+| +|\n")

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = self._bytes()
        if any(re.search(rb"[^ ] |.\n|\n.", t, re.DOTALL) for t in self.tokens):
            raise ValueError("pieces reach over blanks or line ends")
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.lead = self.model.encode("\n")
        self.encoder = Encoder(self._encode, [], REMEMBERED)  # ``exact``, by its rows: the pieces spell the stretch

    def _bytes(self) -> list[bytes]:
        m = self.model
        name = lambda i: m.id_to_piece(i)
        return [
            b"" if m.is_control(i) or m.is_unknown(i) else bytes([int(name(i)[3:-1], 16)]) if m.is_byte(i) else name(i).replace("\u2581", " ").encode()
            for i in range(m.get_piece_size())
        ]

    def _encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not stretches:  # the encoder starts anew
            self.exact = np.zeros(0, bool)
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Behind a line end the model sees each stretch as it stands inside a text.
        ids = [r[len(self.lead) :] for r in self.model.encode(["\n" + s for s in stretches], num_threads=1)]
        spelled = np.array([b"".join(map(self.tokens.__getitem__, r)) == s.encode() for r, s in zip(ids, stretches)], bool)
        self.exact = np.append(self.exact, spelled)
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(r) for r in ids], np.int64)

    def whole(self, text: str) -> list[int] | None:
        """The ids of a text encoded at once; None if they don't spell it."""
        ids = self.model.encode(text, num_threads=1)
        return ids if b"".join(map(self.tokens.__getitem__, ids)) == b" " + text.encode() else None


def cut(ids_a: np.ndarray, n_a: np.ndarray, sizes_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents one after the other: tokens of A and of B up to each common end, within its document, and the
    number of common ends per document. The tokens of both spell the same bytes in each document."""
    i, j = overlaps(np.cumsum(sizes_a[ids_a]), np.cumsum(sizes_b[ids_b]))
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    doc = np.searchsorted(last_a, i, "right")
    return i + 1 - (last_a - n_a)[doc], j + 1 - (last_b - n_b)[doc], np.bincount(doc, minlength=len(n_a))


def _per_text(pieces: list[list[str]], encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = encoder.rows(list(chain.from_iterable(pieces)))
    stops = np.cumsum([len(p) for p in pieces])
    total = np.append(0, np.cumsum(encoder.counts[rows]))
    return encoder.expand(rows), np.diff(total[np.append(0, stops)]), rows, stops


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def align_texts(texts: list[str | None], a: ByteBpe, encoder_a: Encoder, b: Pieces) -> pa.StructArray:
    """One row of FIELDS per text."""
    none = np.zeros(0, np.int64)
    parts: list[pa.StructArray] = []
    for group in list(chunks([t or "" for t in texts], GROUP)) or [[]]:  # a batch may be empty
        own = [texts[n] for n in group]
        there = np.array([n for n, t in enumerate(own) if t], np.int64)
        ids = {"a": none, "b": none}
        counts = {k: np.zeros(len(own), np.int64) for k in ("a", "b", "cut")}
        cuts_a, cuts_b = none, none
        if len(there):
            led = [" " + own[n] for n in there]
            ids_a, n_a, _, _ = _per_text([split(t) for t in led], encoder_a)
            ids_b, n_b, rows, stops = _per_text([b.SPLIT.findall(t) for t in led], b.encoder)
            wrong = np.append(0, np.cumsum(~b.exact[rows]))
            odd = np.diff(wrong[np.append(0, stops)]) > 0
            if odd.any():  # stretches that the model rewrites: those texts are encoded at once
                of_b = np.split(ids_b, np.cumsum(n_b)[:-1])
                of_a = np.split(ids_a, np.cumsum(n_a)[:-1])
                for k in np.flatnonzero(odd):
                    found = b.whole(own[there[k]])
                    of_b[k] = np.array(found or [], np.int64)
                    of_a[k] = of_a[k] if found else none
                ids_a, n_a = np.concatenate(of_a), np.array([len(x) for x in of_a], np.int64)
                ids_b, n_b = np.concatenate(of_b), np.array([len(x) for x in of_b], np.int64)
            cuts_a, cuts_b, n = cut(ids_a, n_a, a.sizes, ids_b, n_b, b.sizes)
            ids = {"a": ids_a, "b": ids_b}
            for k, v in zip(("a", "b", "cut"), (n_a, n_b, n)):
                counts[k][there] = v
        first_a, first_b = (np.repeat(np.cumsum(counts[k]) - counts[k], counts["cut"]) for k in "ab")
        links = pa.StructArray.from_arrays(
            [pa.array(ids["a"][first_a + cuts_a - 1], pa.int32()), pa.array(ids["b"][first_b + cuts_b - 1], pa.int32())], ["a_id", "b_id"])
        parts.append(pa.StructArray.from_arrays([
            _lists(pa.array(ids["a"], pa.int32()), counts["a"]), _lists(pa.array(ids["b"], pa.int32()), counts["b"]),
            _lists(pa.array(cuts_a, pa.int32()), counts["cut"]), _lists(pa.array(cuts_b, pa.int32()), counts["cut"]), _lists(links, counts["cut"]),
        ], FIELDS))
    return pa.concat_arrays(parts)


_READY: dict[tuple[str, str], tuple[ByteBpe, Encoder, Pieces]] = {}  # of this worker, by the files' names


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", into: str = "_aligned",
          then: tuple[str, Callable[[pa.StructArray], pa.Array]] | None = None) -> DataFrame:
    """``docs`` with a struct column ``into``: a_ids, b_ids, a_cuts, b_cuts, links.

    A is a byte-level BPE file of the tokenizers library and encodes a blank and the text; B is a sentence-piece model,
    which adds that blank itself. Neither adds special tokens, and their strings in texts are ordinary text. Where tokens
    of both end at the same byte a group ends: ``a_cuts`` and ``b_cuts`` hold the numbers of tokens up to each such end,
    ``links`` the two ids that end there. Null and empty texts, and texts that a tokenizer rewrites, have empty lists.
    Rows are aligned one by one and whole: repeated rows get equal results, an empty table stays empty, other columns
    pass through. The files are read on the driver; what is broadcast doesn't grow with the data.

    ``then``, a type and a function of alignments, replaces the struct by what the function makes of it within the same
    task, so that token lists needn't leave it.
    """
    bpe = ByteBpe.load(a_path)
    with open(b_path, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast((bpe, bpe.whole, file.read()))
    kind, made = then or (SCHEMA, lambda rows: rows)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = (a_path, b_path)
        if names not in _READY:  # else what was broadcast isn't even opened: a worker would keep it a second time
            a, whole, model = shipped.value
            _READY[names] = (a, Encoder(a.encode_pieces, whole, REMEMBERED), Pieces(model))
        for column in batches:
            # Small groups go back one by one, so neither texts nor tokens of a whole batch are ever held.
            ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) // GROUP
            stops = [*(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(column)]
            for start, stop in zip([0, *stops], stops):
                yield made(align_texts(column.slice(start, stop - start).to_pylist(), *_READY[names]))

    # Not to be copied into the expressions that use its fields.
    return docs.withColumn(into, run.asNondeterministic()(F.col(text)))


def _group_texts(a_ids: np.ndarray, a_cuts: np.ndarray, b_ids: np.ndarray, b_cuts: np.ndarray, words: list[str]) -> str:
    """``a1,a2|b1;a3|b2``: ids of A and B in each group. ``words`` has each id followed by each of the three signs."""
    total = len(a_ids) + len(b_ids)
    group_a, group_b = (np.searchsorted(cuts, np.arange(len(ids)), "right") for ids, cuts in ((a_ids, a_cuts), (b_ids, b_cuts)))
    before_b = np.append(0, b_cuts)[group_a]  # tokens of B that go before a token of A, and the reverse
    code = np.empty(total, np.int64)
    at_a, at_b = np.arange(len(a_ids)) + before_b, np.arange(len(b_ids)) + a_cuts[group_b]
    code[at_a], code[at_b] = 3 * a_ids, 3 * b_ids
    code[at_a[a_cuts - 1]] += 1
    code[at_b[b_cuts - 1]] += 2
    return "".join(map(words.__getitem__, code.tolist()))[:-1]


SUMMARY = "struct<n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, links: array<struct<a_id: int, b_id: int>>>"
_WORDS: list[str] = []  # each id of A or B with each of the three signs behind it


def summary(rows: pa.StructArray) -> pa.StructArray:
    """For ``then``: counts, links, and the SHA-256, in hex, of the groups written ``a1,a2|b1;a3|b2,b3`` ('' without tokens)."""
    lists = [rows.field(n) for n in ("a_ids", "a_cuts", "b_ids", "b_cuts")]
    values = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    offsets = [x.offsets.to_numpy() for x in lists]
    top = max(int(v.max(initial=-1)) for v in (values[0], values[2]))
    _WORDS.extend(f"{i}{sign}" for i in range(len(_WORDS) // 3, top + 1) for sign in ",|;")
    hashes = []
    for r in range(len(rows)):
        parts = [v[o[r] : o[r + 1]] for v, o in zip(values, offsets)]
        hashes.append(hashlib.sha256(_group_texts(*parts, _WORDS).encode()).hexdigest() if len(parts[0]) else "")
    size = lambda n: pa.array(np.diff(rows.field(n).offsets.to_numpy()).astype(np.int64))
    return pa.StructArray.from_arrays(
        [size("a_ids"), size("b_ids"), size("a_cuts"), size("links"), pa.array(hashes, pa.string()), rows.field("links")],
        ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def linkable(a_path: str, b_path: str) -> int:
    """How many pairs of ids can be linked in any text: of two tokens that end together one is the end of the other."""
    with open(b_path, "rb") as file:
        b = Pieces(file.read()).tokens
    a = ByteBpe.load(a_path).tokens
    ends = lambda some, others: sum(1 for t in some for k in range(len(t)) if t[k:] in others)
    in_a, in_b = set(a), set(b)
    twice = len(b) + len(a)  # ids of equal bytes, such as byte pieces, count for each other at most so often
    return ends(a, in_b) + ends(b, in_a) + twice


def count_links(links: DataFrame, most: int) -> DataFrame:
    """(a_id, b_id, n, best) from rows (a_id, b_id): how often each pair is linked, and whether no pair of its B id is
    linked more often. ``most`` bounds the pairs by the vocabularies; up to MAX_PAIRS the result is marked for broadcast."""
    counts = links.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))
    judged = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))
    return F.broadcast(judged) if most <= MAX_PAIRS else judged
