"""Candidates named in questions: the same as by brute force, without shuffling every substring of a question."""

import random

from rankwell.operators import identity as I

QUESTIONS = "question_id string, role string, question string"
RANKINGS = "role string, candidate_id string, rank long, name string"


def mentions(spark, questions, rankings):
    found = I.resolve_references(spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(rankings, RANKINGS)).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def by_hand(questions, rankings):
    return {
        (q, role, c) for q, role, text in questions for r, c, _, name in rankings
        if role == r and role is not None and text and name and name.lower() in text.lower()
    }


def test_names_of_all_lengths_anywhere_in_a_question(spark):
    rng = random.Random(4)

    def word(low, high, letters="abé😀\n "):
        return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

    questions = [(f"q{i}", "rs"[i % 2], word(0, 300)) for i in range(60)] + [("none", "r", None), ("other", None, "ab"), ("alone", "u", "ab")]
    names = [word(1, 14) for _ in range(150)] + ["", None, "?a"]
    # Pieces of the questions: at their ends, over the edges of windows, and longer than those.
    names += [q[a : a + n].upper() for _, _, q in questions[:60] for a, n in [(0, 9), (28, 12), (20, 75), (max(0, len(q) - 11), 11)]]
    rankings = [("rst"[i % 3], f"X_CAND_{i:04d}", i, name) for i, name in enumerate(names)]
    want = by_hand(questions, rankings)
    assert len(want) > 300 and mentions(spark, questions, rankings) == want


def test_many_heads_and_none(spark):
    rng = random.Random(5)
    rankings = [("r", f"X_CAND_{i:04d}", i, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 12)))) for i in range(300)]
    questions = [(f"q{i}", "r", "".join(rng.choice("abcdefgh") for _ in range(200))) for i in range(30)]
    want = by_hand(questions, rankings)
    assert len(want) > 30 and mentions(spark, questions, rankings) == want
    assert mentions(spark, questions, [(*r[:3], None) for r in rankings]) == set() == mentions(spark, [], rankings)


def test_few_heads_of_odd_characters(spark):
    rankings = [("r", f"X_CAND_{i:04d}", i, name) for i, name in enumerate(
        ["Ann", "Annabel Lee Jr", "Annabel Poe", "a.*+?(b)[c]", "\\Q\\E|$^", "😀 smile", "\nline\n", "an", "İstanbul"] + [f"Annabel {'x' * n}" for n in (3, 90, 400)])]
    texts = ["", "ANNABEL LEE JR and ann", "annannabel poeannabel lee jr", "xa.*+?(b)[c]", "ab", "\\q\\e|$^", "x😀 smile😀", "?smile", "a\nline\n", "i̇stanbul", "İSTANBUL",
             "annabel " + "x" * 399, "annabel " + "x" * 401, "ann" * 200]
    questions = [(f"q{i}", "rs"[i == 4], text) for i, text in enumerate(texts)] + [("none", "r", None)]
    want = by_hand(questions, rankings)
    assert len(want) > 20 and mentions(spark, questions, rankings) == want


def records_shuffled(spark) -> int:
    context = spark.sparkContext
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_only_places_where_a_name_can_start_are_shuffled(spark):
    rng = random.Random(6)
    rankings = [("r", f"X_CAND_{i:04d}", i, f"Customer {i:06d}") for i in range(100)]
    questions = [(f"q{i}", "r", "".join(rng.choice("some words of ") for _ in range(500)) + f"customer {i:06d}") for i in range(200)]
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = records_shuffled(spark)
        assert mentions(spark, questions, rankings) == by_hand(questions, rankings)
        assert records_shuffled(spark) - before < 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
