"""Byte-level byte-pair encoding in whole batches, with a proof of which strings need no merging.

``ByteBpe.load`` reads a vocabulary file of the tokenizers library on the driver; the object is shipped to the workers.
``Encoder`` keeps the token ids of the pieces of text that a worker has met.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
from tokenizers import pre_tokenizers

# The split of the byte-level pre-tokenizer, with its letters, numbers and blanks up to U+00FF written out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\xff]")
_NONE = np.iinfo(np.int64).max
LONG = 96  # bytes of a piece from which it is merged by a heap of its own


class _Classes(dict):
    """For str.translate: each character beyond U+00FF becomes one of its class, as the library's pre-tokenizer has it."""

    pre = pre_tokenizers.ByteLevel(add_prefix_space=False)

    def __missing__(self, code: int) -> str:
        if code < 256:
            return chr(code)
        for c in "a0!":
            if len(self.pre.pre_tokenize_str(c + chr(code))) == 1:
                break
        else:
            c = "\t"
        self[code] = c
        return c


_CLASSES = _Classes()


def split(text: str) -> list[str]:
    """The pieces within which the byte-level encoding merges; together they are the text."""
    if not _BEYOND.search(text):
        return SPLIT.findall(text)
    return [text[m.start() : m.end()] for m in SPLIT.finditer(text.translate(_CLASSES))]


def _byte_letters() -> dict[str, int]:
    """The letters by which the file format writes bytes: printable Latin-1 ones as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


@dataclass(frozen=True)
class ByteBpe:
    """Merge rules as arrays: ``keys`` (left * size + right, sorted), their ranks and the tokens they make."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    into: np.ndarray
    tokens: list[bytes]  # by id; special tokens are empty
    specials: tuple[str, ...]

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        """From a file of plain byte-level BPE. Other kinds of tokenizers are a ValueError.

        It is checked that each rule joins tokens made by earlier rules, and that no two rules make the same token: the
        rule of lowest rank can then be applied at all its places at once.
        """
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = model["type"] == "BPE" and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        odd = odd or pre.get("add_prefix_space") or any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word"))
        if not plain or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab, letters = model["vocab"], _byte_letters()
        size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in token)
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {token: -1 for token in vocab if len(token) == 1}
        for rank, (a, b) in enumerate(rules):
            if a + b in made or a not in made or b not in made:
                raise ValueError(f"rule {rank} of {path} is out of order or repeated")
            made[a + b] = rank
        keys = np.array([vocab[a] * size + vocab[b] for a, b in rules], np.int64)
        order = np.argsort(keys)
        into = np.array([vocab[a + b] for a, b in rules], np.int64)
        byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            byte_ids[byte] = vocab[letter]
        return cls(byte_ids, keys[order], order.astype(np.int64), into[order], tokens, tuple(t["content"] for t in added))

    @cached_property
    def whole(self) -> list[str]:
        """The strings that are one token by themselves, proved by merging each string of the vocabulary alone."""
        known = [(i, t) for i, t in enumerate(self.tokens) if t]
        ids, counts = self.merge([t for _, t in known])
        first = np.cumsum(counts) - counts
        found = []
        for (i, token), n, at in zip(known, counts, first):
            try:
                word = token.decode()
            except UnicodeDecodeError:
                continue  # part of a character, never a piece of text
            if n == 1 and ids[at] == i:
                found.append(word)
        return found

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(t) for t in self.tokens], np.int64)

    def _rule(self, key: np.ndarray) -> np.ndarray:
        """The place of each pair's rule, -1 if there is none."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and the number for each word. All words take their next merge together."""
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # word of each token, token
        short = [n for n, w in enumerate(words) if len(w) <= LONG]
        for n, w in enumerate(words):
            if len(w) > LONG:
                ids = self._merge_one(w)
                parts.append((np.full(len(ids), n), ids))
        lengths = np.array([len(words[n]) for n in short], np.int64)
        word = np.repeat(np.array(short, np.int64), lengths)
        ids = self.byte_ids[np.frombuffer(b"".join(words[n] for n in short), np.uint8)]
        size = len(self.tokens)
        while len(ids):
            rule = self._rule(ids[:-1] * size + ids[1:])
            rule[word[1:] != word[:-1]] = -1
            rank = np.append(np.where(rule >= 0, self.ranks[rule], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            widths = np.diff(np.append(starts, len(ids)))
            mine = np.repeat(best, widths)
            done = mine == _NONE
            if done.any():
                parts.append((word[done], ids[done]))
            hits = np.flatnonzero((rank == mine) & ~done)
            if not len(hits):
                break
            # Of places that overlap, like those of "aa" in "aaa", every second one counts, from the left.
            new = np.append(True, hits[1:] != hits[:-1] + 1)
            run = np.flatnonzero(new)
            hits = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))) % 2 == 0]
            ids[hits] = self.into[rule[hits]]
            keep = ~done
            keep[hits + 1] = False
            ids, word = ids[keep], word[keep]
        if not parts:
            return np.zeros(0, np.int64), counts
        word, ids = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words)).astype(np.int64)

    def _merge_one(self, word: bytes) -> np.ndarray:
        """One long word: a heap of (rank, place) over a linked list, so n bytes take n log n steps."""
        rules, size = self._rules, len(self.tokens)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*rule, k, ids[k], ids[k + 1]) for k in range(n - 1) if (rule := rules.get(ids[k] * size + ids[k + 1]))]
        heap = [(rank, k, into, a, b) for rank, into, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, into, a, b = heapq.heappop(heap)
            right = after[k]
            if right < 0 or ids[k] != a or ids[right] != b:
                continue
            ids[k], ids[right] = into, -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left, other in ((before[k], k), (k, after[k])):
                if left >= 0 and other >= 0 and (rule := rules.get(ids[left] * size + ids[other])):
                    heapq.heappush(heap, (rule[0], left, rule[1], ids[left], ids[other]))
        return np.array([i for i in ids if i >= 0], np.int64)

    @cached_property
    def _rules(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.into.tolist())))

    def encode_pieces(self, pieces: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merge([p.encode() for p in pieces])


class Encoder:
    """Token ids of pieces of text, each encoded once; all but ``given`` pieces are forgotten beyond ``limit`` of them."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], given: list[str], limit: int = 500_000):
        self.encode, self.given, self.limit = encode, given, limit
        self._reset()

    def _reset(self) -> None:
        self.at = {p: n for n, p in enumerate(self.given)}
        self.ids, self.counts = self.encode(self.given)
        self.first = np.cumsum(self.counts) - self.counts

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The row of each piece in ``first`` and ``counts``; valid until the next call."""
        if len(self.at) > self.limit + len(self.given):
            self._reset()
        rows = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(rows < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(pieces[k] for k in unknown))
            ids, counts = self.encode(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            rows[unknown] = [self.at[pieces[k]] for k in unknown]
        return rows

    def expand(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the pieces of ``rows``, one after the other."""
        n = self.counts[rows]
        return self.ids[np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def chunks(texts: list[str], limit: int = 2_000_000) -> Iterable[list[int]]:
    """Places of the texts in groups of about ``limit`` characters; a longer text is a group of its own."""
    group, size = [], 0
    for n, text in enumerate(texts):
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(n)
        size += len(text)
    if group:
        yield group
