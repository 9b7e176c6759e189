"""Runs against a search word by word, and grammar extensions against comparison symbol by symbol."""

import hashlib
import random
import zlib

import numpy as np

from rankwell.llm import periodic_runs
from rankwell.llm.grammar import Grammar
from rankwell.llm.queries import QUERIES, table


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            stop = start
            while stop + q < len(words) and words[stop] == words[stop + q]:
                stop += 1
            length = stop + q - start
            if stop > start and length >= max(6, 4 * q):
                own = words[start : start + length]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    out.append((start, length, q))
            start = stop + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        letters = "abcde"[: r.choice([1, 2, 3, 5])]
        words = [r.choice(letters) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            period = [r.choice("xyab") for _ in range(r.randint(1, 6))]
            at = r.randint(0, len(words))
            words[at:at] = (period * 8)[: r.randint(3, 8) * len(period) - r.randint(0, len(period))]
        yield words


def test_extensions_equal_comparison():
    r = np.random.default_rng(0)
    for trial in range(150):
        n = int(r.integers(1, 60))
        word = r.integers(0, int(r.integers(1, 4)), n)
        if trial % 3 == 0:
            word = np.tile(r.integers(0, 3, int(r.integers(1, 8))), n)[:n]
        x, y = (c.ravel() for c in np.meshgrid(np.arange(n), np.arange(n)))
        x, y = x[x != y], y[x != y]
        same = [next((k for k in range(n) if max(a, b) + k >= n or word[a + k] != word[b + k])) for a, b in zip(x, y)]
        assert Grammar(word).extend(x, y).tolist() == same


def test_runs_equal_brute_force():
    texts = list(repeating(500, 4))
    total = 0
    for words, (runs, n, text) in zip(texts, periodic_runs.runs_of([" ".join(w) for w in texts])):
        assert runs == plain_runs(words) and n == len(words) and text == collapsed(words, runs)
        total += len(runs)
    assert total > 500


def test_limits_of_length_and_exponent():
    of = lambda text: periodic_runs.runs_of([text])[0][0]
    assert of("a a a a a") == [] and of("a a a a a a") == [(0, 6, 1)]
    assert of("a b a b a b a") == [] and of("a b a b a b a b") == [(0, 8, 2)]
    assert of("x a b a b a b a b a y") == [(1, 9, 2)]
    assert of("\x1c a b " * 4) == [(0, 8, 2)]  # only plain blanks part words


def test_no_run_goes_over_texts_and_long_ones_end():
    found = periodic_runs.runs_of(["a a a", "a a a", "b " * 120_000, " ".join(str(i % 500) for i in range(60_000))])
    assert [runs for runs, _, _ in found] == [[], [], [(0, 120_000, 1)], [(0, 60_000, 500)]]
    assert found[2][2] == "b" and len(found[3][2].split()) == 500


def test_odd_rows(documents, odd):
    rows = odd + [(200, "k l m " * 9 + "tail"), (200, "k l m " * 9 + "tail")]
    docs = documents(rows)
    out = periodic_runs.find_runs(docs)
    assert out.columns == [*docs.columns, "_runs"] and out.count() == len(rows)
    for r in out.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        expected = plain_runs(words) if len(words) < 2000 else []
        assert [tuple(x) for x in r._runs.runs] == expected and r._runs.n_words == len(words) and r._runs.collapsed == collapsed(words, expected)
    assert periodic_runs.find_runs(documents([])).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got, planted = QUERIES["op13_periodic_runs"](spark, sf).collect(), 0
    assert len(got) == len(texts)
    for r in got:
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = plain_runs(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3))
        assert r.exponent_milli == (top and 1000 * top[1] // top[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(collapsed(words, runs))
    assert planted > 5
