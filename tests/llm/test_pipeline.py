"""The pipeline against a version of every stage in plain Python, and the form of the registered queries' results."""

from collections import defaultdict

import pandas as pd
import pytest

import corpus_pipeline
from rankwell.llm import quality_rules, secret_scan
from rankwell.llm.queries import ORACLES, QUERIES, table
from tests.llm.test_decontamination import brute as overlapping, straying
from tests.llm.test_mixing import poured
from tests.llm.test_near_dedup import truth
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def masked(text):
    spans = sorted((f for rule in secret_scan.RULES for f in secret_scan.find(text, rule, secret_scan._compiled(rule))), key=lambda f: (f[1], -f[2]))
    parts, at = [], 0
    for kind, start, stop in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, stop)
    return "".join([*parts, text[at:]])


def test_stages_equal_plain_python(spark):
    docs = table(spark, SF, "documents")
    trees = quality_rules.train(docs, table(spark, SF, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    counts = pd.DataFrame([quality_rules.document_counts(r.text) for r in rows.values()], columns=quality_rules.COUNTS)
    good = ~quality_rules.base_failed(counts) & (trees.probability(quality_rules.features(counts)) >= 0.5)
    texts = [(i, r.text) for (i, r), ok in zip(rows.items(), good) if ok]
    texts = [(i, rows[i].text) for i, _, _, kept in truth(texts, 5, 80) if kept]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaks = {i for i, *_ in overlapping(texts, items)} | {i for i, _ in straying(texts, items)}
    texts = {i: masked(t) for i, t in texts if i not in leaks}

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "benchmark decontamination", "secret scan", "mixing"]
    kept = docs
    for name in list(stages)[:-1]:
        kept = stages[name](spark, kept, SF).cache()
        assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text != rows[r.doc_id].text)

    sizes = defaultdict(int)
    for i, t in texts.items():
        sizes[rows[i].source] += len(t.encode().split())
    names = sorted(sizes)
    targets = dict(zip(names, poured([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3)))
    taken, seen = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        taken[r.source] += r.n_words
        seen[r.doc_id] += r.n_words
        assert r.target == pytest.approx(targets[r.source]) and r.size == len(texts[r.doc_id].encode().split())
    assert set(seen) == set(texts)
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in names)
    assert all(n <= 3 * len(texts[i].encode().split()) for i, n in seen.items())


COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted", "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_quality_classifier": "doc_id held_out score predicted", "op4_url_filters": "page_id host path rule verdict",
    "op5_mixing": "doc_id size source_size target taken n_shards n_pieces spans_sha256", "op6_minhash_dedup": "doc_id n_shingles component_id kept",
    "op7_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score", "op8_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to", "op10_decontamination": "doc_id item_id",
    "op11_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


def test_all_operators_have_a_query():
    assert sorted(QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_its_columns_and_rows(spark, name):
    out = QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    if name != "op10_decontamination":
        assert out.count() == table(spark, SF, "pages" if "page_id" in out.columns else "documents").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    verdict = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict
