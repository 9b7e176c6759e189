"""Token counts against the tokenizers library."""

import random

import pytest
from tokenizers import Tokenizer

from rankwell.llm import bpe, token_counts
from rankwell.llm.queries import QUERIES, table, tokenizer

PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def rules():
    return bpe.ByteBpe.load(PATH)


def noise(n, seed):
    """Texts of letters, numbers, blanks and signs of many scripts, and of any code points."""
    r = random.Random(seed)
    close = "aaab 'srtéß\n\t  0123²½!?<|endoftext|>　漢字かñ\U0001f600՘\x85\xa0"
    wide = lambda: chr(r.choice([r.randint(1, 0x2FF), r.randint(1, 0xD7FF), r.randint(0x10000, 0x1FFFF)]))
    return ["".join(r.choice(close) if k % 2 else wide() for _ in range(r.randint(0, 200))) for k in range(n)]


ODD = ["", "<|endoftext|>a<|endoftext|><|endoftext|>", " <|endoftext| > ", "a" * 5000, "ab" * 3000, " " * 1000, "\n" * 50 + "a", "it's we'll I'M don't 's"]


def test_pieces_and_ids_equal_the_library(rules, library):
    texts = noise(600, 1) + ODD
    encoder = bpe.Encoder(rules.encode_pieces, rules.whole)
    library.encode_special_tokens = True
    for text in texts:
        pieces = bpe.split(text)
        assert "".join(pieces) == text
        assert encoder.expand(encoder.rows(pieces)).tolist() == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = False


def test_whole_tokens_are_those_the_library_leaves_whole(rules, library):
    whole = set(rules.whole)
    assert len(whole) > 49_000
    ids = {w: library.model.token_to_id(library.pre_tokenizer.pre_tokenize_str(w)[0][0]) for w in list(whole)[::50] if len(library.pre_tokenizer.pre_tokenize_str(w)) == 1}
    assert all([t.id for t in library.model.tokenize(library.pre_tokenizer.pre_tokenize_str(w)[0][0])] == [i] for w, i in ids.items())


def test_heap_and_batches_merge_alike(rules):
    r = random.Random(2)
    words = ["".join(r.choice("aabcdeé") for _ in range(r.randint(1, 90))).encode()[: bpe.LONG] for _ in range(300)]
    ids, counts = rules.merge(words)
    at = 0
    for word, n in zip(words, counts):
        assert rules._merge_one(word).tolist() == ids[at : at + n].tolist()
        at += n


def test_an_encoder_forgets_and_goes_on(rules):
    encoder = bpe.Encoder(rules.encode_pieces, rules.whole[:100], 50)
    expected = [rules.encode_pieces([f"zq{k}xv"])[1][0] for k in range(400)]
    got = []
    for k in range(0, 400, 20):
        rows = encoder.rows([f"zq{n}xv" for n in range(k, k + 20)])
        got += encoder.counts[rows].tolist()
    assert got == expected and len(encoder.at) < 200


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe.load(tokenizer("word_bpe_49k.json"))


@pytest.mark.parametrize("special", [True, False])
def test_counts_on_odd_rows(documents, odd, library, special):
    rows = odd + [(100 + n, t) for n, t in enumerate(noise(40, 3) + ODD)]
    docs = documents(rows)
    out = token_counts.count_tokens(docs, PATH, special_tokens=special)
    assert out.columns == [*docs.columns, "_n_tokens"]
    library.encode_special_tokens = not special
    expected = sorted((str(i), str(t), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    library.encode_special_tokens = False
    assert sorted((str(r.doc_id), str(r.text), r._n_tokens) for r in out.collect()) == expected
    assert token_counts.count_tokens(documents([]), PATH).count() == 0


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = QUERIES["op12_token_counts"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
