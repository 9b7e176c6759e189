import random

import pytest

from rankwell.llm import near_dedup as N
from rankwell.llm.common import WordHashes, connected_components


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def truth(rows, k, percent):
    """Smallest reachable id and set size per row, from all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[n] and rows[m][0] is not None]
        low = min(ids, default=None) if sets[n] else i
        out.append((i, len(sets[n]), low, i == low))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_components_equal_those_of_all_pairs(documents, prose, odd):
    rows = [*odd]
    for family in range(6):
        base = prose(120, 100 + family)
        rows += [(1000 * family + 10 + i, edited(base, i % 9, 77 * family + i)) for i in range(14)]
    rows += [(9000, "one two three"), (9001, "One  TWO three"), (9002, "one two")]
    for k, percent in ((4, 80), (5, 80)):
        assert got(N.near_duplicates(documents(rows), shingle=k, percent=percent)) == truth(rows, k, percent)


@pytest.mark.parametrize("pairs", [0, 1, 100])
def test_large_buckets_are_resolved_without_losing_links(documents, prose, monkeypatch, pairs):
    # chains of edits: most members aren't linked to any single leader
    monkeypatch.setattr(N, "DIRECT", 3)
    monkeypatch.setattr(N, "PAIRS", pairs)
    base, rows = prose(90, 5), []
    for i in range(60):
        base = edited(base, 2, i)
        rows.append((i, base))
    rows += [(100 + i, edited(rows[0][1], i % 12, 500 + i)) for i in range(60)]
    assert got(N.near_duplicates(documents(rows), shingle=4)) == truth(rows, 4, 80)


def test_empty_table_and_kept_rows(documents, prose):
    assert N.near_duplicates(documents([])).count() == 0
    rows = [(3, prose(50, 1)), (1, prose(50, 1)), (2, prose(50, 2)), (None, prose(50, 1))]
    kept = N.keep_one_of_each_group(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2]


def test_signature_estimates_similarity():
    hashes = WordHashes()
    a = N.shingle_set([str(i).encode() for i in range(2000)], hashes, 1)
    b = N.shingle_set([str(i).encode() for i in range(500, 2500)], hashes, 1)
    equal = (N.signature(a) == N.signature(b)).mean()
    assert abs(equal - 1500 / 2500) < 0.15


@pytest.mark.parametrize("pairs,expected", [
    ([], {}),
    ([(1, 2), (2, 3), (9, 8), (None, 4), (5, 5)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(0, i) for i in range(1, 50)] + [(50, i) for i in range(40, 60) if i != 50], {i: 0 for i in range(60)}),
])
def test_connected_components(spark, pairs, expected):
    df = spark.createDataFrame(pairs, "a int, b int")
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == expected
