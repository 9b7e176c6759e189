"""Alignments against the two libraries and plain sets of byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankwell.llm import bpe, token_alignment
from rankwell.llm.queries import QUERIES, table, tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, B ids, groups), all empty where the bytes differ."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    bytes_a = bpe.ByteBpe.load(A).tokens
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def align(text):
        if not text:
            return [], [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a, of_b = [bytes_a[i] for i in ids_a], [piece(i) for i in ids_b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return [], [], []
        ends_a, ends_b = (np.cumsum([len(t) for t in x]).tolist() for x in (of_a, of_b))
        groups, at, bt = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            next_a, next_b = ends_a.index(end, at) + 1, ends_b.index(end, bt) + 1
            groups.append((ids_a[at:next_a], ids_b[bt:next_b]))
            at, bt = next_a, next_b
        return ids_a, ids_b, groups

    return align


def test_diagonals_and_pieces_of_any_size():
    for seed in range(6):
        r = np.random.default_rng(seed)
        a, b = (np.unique(r.integers(0, 300, n)) for n in (150, 40 * seed))
        merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
        counts = np.append(0, np.cumsum([side == 0 for _, side in merged]))
        assert token_alignment.diagonal(a, b, np.arange(len(merged) + 1)).tolist() == counts.tolist()
        for work in (1, 2, 3, 7, 1000):
            i, j = token_alignment.overlaps(a, b, work)
            assert (a[i] == b[j]).all() and a[i].tolist() == np.intersect1d(a, b).tolist()


def noise(n, seed):
    r = random.Random(seed)
    close = "aaab 'srtéß\n\t  0123²½!?▁　漢字かñ\U0001f600\x85\xa0\x00"
    wide = lambda: chr(r.choice([r.randint(1, 0x2FF), r.randint(1, 0xD7FF), r.randint(0x10000, 0x1FFFF)]))
    return ["".join(r.choice(close) if k % 2 else wide() for _ in range(r.randint(0, 120))) for k in range(n)]


ODD = ["<s> a </s> <unk> <0x41> <|endoftext|>", " ", "\n", " \n ", "a▁b", "  ", "a" * 3000, " lead", "trail  ", "x\n\ny", "tab\tq"]


def test_alignment_on_odd_rows(documents, odd, plain):
    rows = odd + [(100 + n, t) for n, t in enumerate(noise(200, 5) + ODD)]
    docs = documents(rows)
    out = token_alignment.align(docs, A, B)
    assert out.columns == [*docs.columns, "_aligned"]
    got = out.collect()
    assert len(got) == len(rows)
    summed = token_alignment.align(docs, A, B, into="s", then=(token_alignment.SUMMARY, token_alignment.summary)).collect()
    shas = {r.text: r.s.groups_sha256 for r in summed}
    assert len(summed) == len(rows) and all(r.s.n_links == len(r.s.links) == r.s.n_groups for r in summed)
    for r in got:
        ids_a, ids_b, groups = plain(r.text)
        x = r._aligned
        assert (x.a_ids, x.b_ids) == (ids_a, ids_b), r.text
        assert x.a_cuts == np.cumsum([len(g[0]) for g in groups], dtype=int).tolist() and x.b_cuts == np.cumsum([len(g[1]) for g in groups], dtype=int).tolist()
        assert [(k.a_id, k.b_id) for k in x.links] == [(g[0][-1], g[1][-1]) for g in groups]
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        assert shas[r.text] == (hashlib.sha256(written.encode()).hexdigest() if groups else "")
    for then in (None, (token_alignment.SUMMARY, token_alignment.summary)):
        assert token_alignment.align(documents([]), A, B, then=then).count() == 0


def test_linked_pairs_stay_below_the_bound(documents, plain, spark):
    most = token_alignment.linkable(A, B)
    assert most <= token_alignment.MAX_PAIRS
    tokens_a, tokens_b = bpe.ByteBpe.load(A).tokens, token_alignment.Pieces(open(B, "rb").read()).tokens
    for text in noise(60, 8):
        for g in plain(text)[2]:
            a, b = tokens_a[g[0][-1]], tokens_b[g[1][-1]]
            assert a.endswith(b) or b.endswith(a)


def test_counts_of_links(spark):
    links = [(1, 1)] * 3 + [(2, 1)] * 3 + [(3, 1)] + [(3, 2)]
    for most in (10, token_alignment.MAX_PAIRS + 1):
        got = token_alignment.count_links(spark.createDataFrame(links, "a_id int, b_id int"), most)
        assert {tuple(r) for r in got.collect()} == {(1, 1, 3, True), (2, 1, 3, True), (3, 1, 1, False), (3, 2, 1, True)}


def test_query_equals_plain_python(spark, plain):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    groups = {i: plain(t)[2] for i, t in texts.items()}
    pairs = Counter((g[0][-1], g[1][-1]) for own in groups.values() for g in own)
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    got = QUERIES["op11_token_alignment"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        own = groups[r.doc_id]
        counts = [(pairs[g[0][-1], g[1][-1]], best[g[1][-1]]) for g in own]
        assert (r.n_a, r.n_b) == (sum(len(g[0]) for g in own), sum(len(g[1]) for g in own))
        assert (r.n_groups, r.n_links) == (len(own), len(own))
        assert (r.n_best, r.count_sum) == (sum(n == top for n, top in counts), sum(n for n, _ in counts))
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in own)
        assert r.groups_sha256 == (hashlib.sha256(written.encode()).hexdigest() if own else "")
