import numpy as np
import pandas as pd

from rankwell.llm import quality_rules as Q


def test_counts_by_hand():
    text = "a b c a b c\nx # y\n\nx # y\n a|b\n"
    counts = dict(zip(Q.COUNTS, Q.document_counts(text)))
    assert counts["n_words"] == 13 and counts["word_chars"] == 15
    assert counts["n_symbols"] == 3 and counts["n_dup_lines"] == 1
    assert counts["n_repeat_words"] == 12  # a b c twice, x # y twice
    assert Q.document_counts("a a a a")[4] == 4 and Q.document_counts("a a a")[4] == 0
    assert Q.document_counts("é\x1cé é")[:2] == (2, 4)
    assert Q.document_counts(None) == Q.document_counts("") == (0,) * len(Q.COUNTS)


def test_repeated_words_equal_brute_force(prose):
    import random
    for seed in range(20):
        r = random.Random(seed)
        words = [r.choice("abcd") for _ in range(r.randint(0, 60))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert Q.repeated_words(words) == len(inside)


def noisy(n=600, seed=1):
    r = np.random.default_rng(seed)
    x = r.random((n, len(Q.FEATURES)))
    y = ((x[:, 2] < 0.5) & (x[:, 0] > 0.2)).astype(float)
    flip = r.random(n) < 0.05
    return x, np.where(flip, 1 - y, y), y


def test_trees_learn_and_keep_monotonic_constraints():
    x, y, clean = noisy()
    trees = Q.fit_trees(x, y)
    assert ((trees.probability(x) > 0.5) == clean).mean() > 0.95
    for j, sign in enumerate(Q.FEATURES.values()):
        if sign:
            low, high = x.copy(), x.copy()
            low[:, j], high[:, j] = 0.1, 0.9
            assert (sign * (trees.probability(high) - trees.probability(low)) >= -1e-12).all()


def test_flat_arrays_equal_a_walk_by_hand():
    x, y, _ = noisy(200, 2)
    t = Q.fit_trees(x, y, n_trees=5)
    for row, p in zip(x[:20], t.probability(x[:20])):
        total = t.prior
        for root in t.roots:
            node = root
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        assert abs(1 / (1 + np.exp(-total)) - p) < 1e-12


def test_one_class_and_ties():
    x, y = np.zeros((30, len(Q.FEATURES))), np.ones(30)
    assert (Q.fit_trees(x, y).probability(x) > 0.9).all()


def test_judge_on_odd_rows(documents, odd, spark):
    docs = documents(odd)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    for trees in (None, Q.train(docs, labels), Q.train(docs, labels.limit(0))):
        out = Q.judge(docs, trees)
        assert out.count() == len(odd) and out.columns == [*docs.columns, "_quality"]
        rows = [(r.doc_id, r.text, r._quality) for r in out.collect()]
        for i, text, q in rows:
            expected = Q.document_counts(text)
            assert tuple(q[c] for c in Q.COUNTS) == expected
            assert q.base_failed == bool(Q.base_failed(pd.DataFrame([expected], columns=Q.COUNTS))[0])
            assert not (q.kept and q.base_failed)
    assert Q.keep_good(docs, None).columns == docs.columns
    assert Q.keep_good(documents([]), None).count() == 0
    clashing = docs.selectExpr("*", "'q' AS _quality")
    assert Q.keep_good(clashing, None).columns == clashing.columns and {r._quality for r in Q.keep_good(clashing, None).collect()} == {"q"}


def test_junk_goes_and_prose_stays(documents, prose, spark):
    good = [(i, "\n".join(prose(40, 10 * i + j) for j in range(4))) for i in range(60)]
    junk = [(100 + i, " | ".join(prose(60, 900 + i).split())) for i in range(30)]
    docs = documents(good + junk)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + junk if i % 2], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in Q.keep_good(docs, Q.train(docs, labels)).collect()}
    assert kept == {i for i, _ in good}
