import numpy as np

from rankwell.llm import quality_classifier as Q


def test_contexts_equal_brute_force(monkeypatch):
    index = Q.index_vectors()
    slots = np.random.default_rng(1).integers(0, 50, 300)
    expected = np.zeros((Q.SLOTS, Q.WIDTH), np.int64)
    for i, s in enumerate(slots):
        for d in (-2, -1, 1, 2):
            if 0 <= i + d < len(slots):
                expected[s] += index[slots[i + d]]
    for piece in (7, 100, 1000):
        monkeypatch.setattr(Q, "PIECE", piece)
        table = np.zeros_like(expected)
        Q.add_contexts(table, slots, index)
        assert (table == expected).all()


def test_word_vectors_do_not_depend_on_the_partitions(documents, odd, prose):
    docs = documents([*odd, *[(100 + i, prose(30, i)) for i in range(40)]])
    one, many = Q.word_vectors(docs.coalesce(1)), Q.word_vectors(docs.repartition(7))
    assert (one == many).all()
    norms = np.linalg.norm(one, axis=1)
    assert ((np.abs(norms - 1) < 1e-3) | (norms < 1e-6)).all() and norms.max() > 0.9


def test_pooling():
    vectors = np.random.default_rng(2).normal(size=(Q.SLOTS, Q.WIDTH)).astype(np.float32)
    slots = np.array([5, 9, 5, 11])
    rows = vectors[slots].astype(float)
    expected = np.concatenate([rows.mean(axis=0), rows.std(axis=0), [np.log1p(4)]])
    assert np.allclose(Q.pooled(slots, vectors), expected, atol=1e-6)
    assert (Q.pooled(np.empty(0, np.int64), vectors) == 0).all()


def test_network_learns_and_temperature_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, Q.N_FEATURES))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(1500) < p).astype(float)
    net = Q.fit_network(x[:1000], y[:1000])
    got = net.probability(x[1000:])
    assert ((got > 0.5) == (p[1000:] > 0.5)).mean() > 0.75
    assert net.temperature > 1  # it has been too sure of the rows it learned from
    assert abs(got.mean() - p[1000:].mean()) < 0.08


def test_held_out_accuracy(documents, prose, spark):
    good = [(i, prose(80, i)) for i in range(200)]
    junk = [(1000 + i, " | ".join(prose(60, 5000 + i).split())) for i in range(60)]
    docs = documents(good + junk)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + junk], "doc_id bigint, quality int, toxic int")
    vectors = Q.word_vectors(docs)
    network = Q.train(docs, labels.where("doc_id % 4 <> 0"), vectors)
    rows = Q.score(docs, vectors, network).where("doc_id % 4 = 0").collect()
    assert sum((r.score >= 0.3) == (r.doc_id < 1000) for r in rows) / len(rows) > 0.95


def test_odd_rows(documents, odd, spark):
    docs = documents(odd)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (None, 0, 1), (7, None, 0), (1, 0, 1), (2, 1, 1)], none.schema)
    vectors = Q.word_vectors(docs)
    for labels in (none, some):
        out = Q.score(docs, vectors, Q.train(docs, labels, vectors)).collect()
        assert len(out) == len(odd) and all(0 <= r.score <= 1 for r in out)
    empty = documents([])
    assert Q.score(empty, Q.word_vectors(empty), None).count() == 0
