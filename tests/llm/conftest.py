import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, class string, key int, words string, score int, component string"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text) rows, with further columns whose names the operators use themselves."""

    def build(rows, source=lambda i: f"src{i % 3}"):
        full = [(i, t, "en", source(n), None if t is None else len(t), "x", 1, "w", 2, None) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, the same for the same seed."""

    def build(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))

    return build


@pytest.fixture(scope="session")
def odd(prose):
    """Null, empty and blank texts, null and repeated ids, repeated rows, ties, other scripts, and a very long text."""
    return [(1, None), (2, ""), (3, " \n\t "), (None, "short text"), (None, None), (4, prose(60, 4)), (4, prose(60, 4)), (5, prose(60, 4)), (6, "Ünïcode \x1c　 «слово» \U0001f600 " * 20), (7, prose(40_000, 7))]
