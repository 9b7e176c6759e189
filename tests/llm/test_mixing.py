import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankwell.llm import mixing as M


def poured(sizes, weights, repeats):
    """Targets by sharing out again and again, as the definition says."""
    total, full, target = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        rest, share = total - sum(repeats * sizes[i] for i in full), sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / share > repeats * sizes[i] + 1e-9]
        if not over:
            return [repeats * sizes[i] if i in full else rest * weights[i] / share for i in range(len(sizes))]
        full |= set(over)


@pytest.mark.parametrize("sizes", [[100, 50, 20, 1000], [5, 5000, 7, 9, 1], [10], [0, 3, 4], [7, 7, 7, 7, 7, 7]])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes[:-1])] + [(None, sizes[-1])]
    out = M.targets(spark.createDataFrame(rows, "source string, size bigint")).orderBy("rank").collect()
    assert [r.source for r in out] == [s for s, _ in rows]
    expected = poured(sizes, [M.WEIGHTS[i % 3] for i in range(len(sizes))], 3)
    assert [r.target for r in out] == pytest.approx(expected)


def test_splitting_tree_has_exact_margins_and_fair_shares(spark):
    quotas = [300, 41, 0, 7]
    df = spark.createDataFrame(list(enumerate(quotas)), "rank int, blocks bigint")
    seen = defaultdict(list)
    for seed in range(12):
        out = M.split_blocks(df, 3, seed).collect()
        shards = defaultdict(int)
        for r in out:
            shards[r.shard] += r.quota
            seen[r["rank"]].append(r.quota)
        assert [sum(r.quota for r in out if r["rank"] == i) for i in range(4)] == quotas
        assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 1
        assert min(r.quota for r in out) >= 0
    # hypergeometric: 41 of 348 blocks, 43.5 to a shard
    mean = sum(seen[1]) / len(seen[1])
    spread = sum((q - mean) ** 2 for q in seen[1]) / len(seen[1])
    law = 43.5 * (41 / 348) * (307 / 348) * ((348 - 43.5) / 347)
    assert mean == pytest.approx(41 / 8) and 0.6 * law < spread < 1.5 * law


def test_pieces_cover_targets_once(documents, prose, odd):
    rows = [*odd[:-1], *[(100 + i, prose(5 + i % 40, i)) for i in range(120)]]
    docs = documents(rows, source=lambda n: ["a", "b", None, "c", "a", "a"][n % 6])
    pieces = M.mix(docs, levels=2, blocks=64).cache()
    goals = {r.source: r for r in pieces.groupBy("source").agg(F.max("target").alias("t"), F.max("source_size").alias("s"), F.sum("n_words").alias("n")).collect()}
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    assert {s: g.s for s, g in goals.items()} == dict(sizes)
    assert all(abs(g.n - g.t) <= 0.5 for g in goals.values())
    assert pieces.select("place").distinct().count() == len(rows)
    worst = pieces.groupBy("place", "size").agg(F.sum("n_words").alias("n")).where("n > 3 * size").count()
    assert worst == 0
    taken = pieces.where("n_words > 0")
    assert taken.where("shard IS NULL OR first_word < 0 OR first_word + n_words > size").count() == 0
    # no word is taken twice in one reading, and blocks have distinct positions
    spans = sorted((str(r.place), r.epoch, r.first_word, r.n_words) for r in taken.collect())
    assert all(a[:2] != b[:2] or a[2] + a[3] <= b[2] for a, b in zip(spans, spans[1:]))
    shards = taken.groupBy("shard").agg(F.countDistinct("position").alias("n"), F.max("position").alias("top")).collect()
    assert len(shards) == 4 and all(s.top == s.n - 1 for s in shards)
    again = M.mix(docs.repartition(5), levels=2, blocks=64)
    assert again.exceptAll(pieces).count() == 0
    pieces.unpersist()


def test_rows_by_document_hold_what_the_tree_dealt(documents, prose, monkeypatch):
    rows = [(i, prose(5 + i % 40, i)) for i in range(60)]
    docs = documents(rows, source=lambda n: "aab"[n % 3])
    pieces = M.mix(docs, levels=2, blocks=32).cache()
    by_doc = {r.doc_id: r for r in M.by_document(pieces).collect()}
    spans = defaultdict(list)
    for r in pieces.where("shard IS NOT NULL").orderBy("epoch", "first_word").collect():
        spans[r.doc_id].append((r.shard, f"{r.shard}:{r.position}:{r.epoch}:{r.first_word}:{r.n_words}", r.n_words))
    for i, _ in rows:
        assert by_doc[i].spans_sha256 == hashlib.sha256(",".join(s for _, s, _ in spans[i]).encode()).hexdigest()
        assert (by_doc[i].n_pieces, by_doc[i].n_shards, by_doc[i].taken) == (len(spans[i]), len({s for s, _, _ in spans[i]}), sum(n for *_, n in spans[i]))
    # a tree that deals one source's blocks to nobody leaves its words out: quotas decide what is taken
    whole = M.split_blocks
    monkeypatch.setattr(M, "split_blocks", lambda *a: whole(*a).where("rank != 0"))
    assert {r.source for r in M.mix(docs, levels=2, blocks=32).where("n_words > 0").collect()} == {"b"}
    pieces.unpersist()


def test_empty_tables(documents):
    assert M.mix(documents([])).count() == 0
    out = M.mix(documents([(1, None), (2, ""), (None, " ")])).collect()
    assert [(r.size, r.target, r.n_words) for r in out] == [(0, 0.0, 0)] * 3
