import random

import pytest

from rankwell.llm import toxicity as T


STEMS = ("idiot", "moron", "stupid", "scum", "worthless")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(word, stems):
    if any(word.startswith(s) for s in stems):
        return 0
    return min((d for s in stems if (d := distance(word, s)) <= T.allowed_edits(s)), default=None)


def test_machine_equals_edit_distances():
    r = random.Random(1)
    stems = ("abab", "ababa", "bbaab", "aabbaabba", "abcabcabcabc", "ba")
    machine = T.Machine(stems)
    for _ in range(3000):
        word = "".join(r.choice("abc") for _ in range(r.randint(0, 13)))
        assert machine.match(word) == brute(word, stems), word


def test_misspellings_are_caught():
    machine = T.Machine(STEMS)
    assert [machine.match(w) for w in ("idiot", "idiots", "idoit", "idi0t", "stupd", "worthles", "wrothless", "idea", "")] == [0, 0, None, 1, 1, 1, 2, None, None]


def test_machine_forgets_within_bounds(monkeypatch):
    monkeypatch.setattr(T.Machine, "LIMIT", 30)
    machine = T.Machine(STEMS)
    for i in range(500):
        machine.match(f"word{i}")
        assert len(machine.words) <= 31
    assert machine.match("idiot") == 0


def test_windows_tell_quotation_from_abuse():
    machine = T.Machine(STEMS)
    abuse = T.features("you are such an idiot and everyone knows", machine)
    quoted = T.features('the paper said “such an idiot” in its report', machine)
    assert abuse[0] > quoted[0] > 0 and abuse[1] == 1.25 and quoted[1] < 0.2
    assert T.features(None, machine) == T.features("", machine) == T.features("nothing here", machine) == [0.0] * T.N_FEATURES


@pytest.fixture(scope="module")
def corpus(documents, prose, spark):
    r, rows, labels = random.Random(2), [], []
    for i in range(300):
        words, toxic = prose(80, 3000 + i).split(), int(i % 4 == 0)
        if toxic:
            for _ in range(4):
                words[r.randrange(80)] = r.choice(["zorkel" + r.choice(["n", "s", "haft"]), "idiot"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_learns_stems_and_scores_held_out_rows(corpus):
    docs, labels = corpus
    model = T.train(docs, labels.where("doc_id % 3 <> 1"))
    assert any("zorkel".startswith(s) or s.startswith("zorkel") for s in model.stems)
    rows = T.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    assert sum((r.score >= 0.7) == (r.toxic == 1) for r in rows) / len(rows) > 0.95
    clean = [r.score for r in rows if not r.toxic]
    assert max(clean) < 0.7


def test_odd_rows(documents, odd, spark):
    docs = documents(odd)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    nulls = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (None, 0, 1), (7, 0, None), (1, 0, 1), (77, 0, 1)], none.schema)
    for labels in (none, nulls):
        out = T.score(docs, T.train(docs, labels)).collect()
        assert len(out) == len(odd) and all(0 <= r.score <= 1 for r in out)
    assert T.score(documents([]), T.train(docs, none)).count() == 0
