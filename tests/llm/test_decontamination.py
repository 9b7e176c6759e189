import random
import re
from collections import Counter, defaultdict

from rankwell.llm import decontamination as D


def tokens(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def equal_by_shift(words, item):
    """Equal tokens of each alignment: words of the text by position, met with those of the item."""
    places = defaultdict(list)
    for at, w in enumerate(words):
        places[w].append(at)
    return Counter(at - k for k, token in enumerate(item) for at in places.get(token, ()))


def brute(docs, items, least=8, percent=50):
    """All straight alignments, judged token by token; no masks, as no seed is needed for one that counts."""
    out = set()
    for i, text in docs:
        w = tokens(text)
        for j, item in items:
            t = tokens(item)
            good = [(-n, shift) for shift, n in equal_by_shift(w, t).items() if n >= least and 100 * n >= percent * len(t)]
            if good:
                n, shift = min(good)
                out.add((i, j, shift, min(len(w), shift + len(t)) - max(0, shift), -n))
    return out


def straying(docs, items, least=8, percent=50):
    """(doc, item) that count by a path over neighbouring alignments; a path has no more equal tokens than all of them."""
    out = set()
    for i, text in docs:
        w = tokens(text)
        for j, item in items:
            t = tokens(item)
            counts = equal_by_shift(w, t)
            need = max(least, -(-percent * len(t) // 100))
            near = [s for s in counts if sum(counts[s + d] for d in range(-D.SLACK, D.SLACK + 1)) >= need]
            if any(path_at(w, t, s, D.SLACK) >= need for s in near):
                out.add((i, j))
    return out


def got(df):
    return {tuple(r) for r in df.select("doc_id", "item_id", "first_word", "n_compared", "n_equal").collect()}


def test_equals_brute_force(documents, prose, odd, spark):
    r = random.Random(3)
    items = [(i, prose(r.randint(12, 40), 50 + i)) for i in range(8)] + [(8, None), (9, ""), (10, "too short an item"), (3, prose(20, 53))]
    docs = [row for row in odd if row[0] != 7]
    for n in range(40):
        w, t = prose(80, 200 + n).split(), (items[n % 8][1]).split()
        for k in range(len(t)):
            if r.random() < (n % 5) * 0.05:
                t[k] = "changed"
        cut = t[: len(t) // 2] if n % 7 == 0 else t
        at = r.randint(0, 80)
        docs.append((100 + n, " ".join([*w[:at], *cut, *w[at:]])))
    docs += [(500, items[0][1]), (500, items[0][1]), (501, items[0][1].upper().replace(" ", ", "))]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(docs, items)
    assert len({e[0] for e in expected}) > 30
    assert got(D.overlaps(documents(docs), table)) == expected


def test_filter_and_empty_tables(documents, prose, spark):
    items = spark.createDataFrame([(1, prose(20, 1))], "item_id bigint, text string")
    docs = documents([(1, prose(30, 9) + " " + prose(20, 1)), (1, prose(40, 3)), (2, prose(50, 2)), (None, prose(20, 1)), (None, prose(40, 4)), (3, None)])
    docs = docs.selectExpr("*", "1 AS _gone", "2 AS __gone", "'k' AS _key")
    left = D.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "None"]
    assert {(r._gone, r["__gone"], r._key) for r in left.collect()} == {(1, 2, "k")}
    assert D.drop_contaminated(documents([]), items).count() == 0
    assert D.overlaps(documents([]), items).count() == 0
    assert D.overlaps(docs, items.limit(0)).count() == 0


def path_at(w, t, shift, slack):
    """The best path of ``t`` through ``w`` within ``slack`` of an alignment; no masks."""
    s = {d: 0 for d in range(shift - slack, shift + slack + 1)}
    for i, token in enumerate(t):
        n = {d: max(v + (0 <= i + d < len(w) and w[i + d] == token), s.get(d + 1, 0) - 1) for d, v in s.items()}
        s = {d: max(v - (d - e) for e, v in n.items() if e <= d) for d in n}
    return max(s.values())


def path(w, t, slack):
    return max(path_at(w, t, shift, slack) for shift in range(-len(t), len(w)))


def test_no_seed_is_needed(documents, prose, spark):
    r = random.Random(5)
    items = [(k, " ".join(f"it{k}x{n}" for n in range(size))) for k, size in enumerate([8, 9, 10, 12, 15, 17, 20, 24, 40])]
    docs, straight = [], set()
    for k, item in items:
        t = item.split()
        need = max(8, -(-len(t) // 2))
        for n in range(30):
            equal = set(r.sample(range(len(t)), r.randint(need - 2, min(need + 2, len(t)))))
            docs.append((len(docs), " ".join([*prose(20, n).split()[: n % 3], *[x if i in equal else "other" for i, x in enumerate(t)], *prose(9, n).split()[: n % 2 * 9]])))
            straight |= {(docs[-1][0], k)} if len(equal) >= need else set()
    for k, item in items:  # words put in and taken out
        t = item.split()
        for n in range(6):
            at, copy = len(t) // 2 + n % 2, list(t)
            if n < 2:
                copy[at:at] = ["put", "in", "here"][: n + 1]
            elif n < 4:
                del copy[at : at + n - 1]
            else:
                copy[3 : 4 if n == 4 else 3] = [] if n == 4 else ["put"]
                copy[at:at] = ["in"]
            docs.append((len(docs), " ".join([*prose(12, n).split(), *copy, *prose(12, n + 1).split()])))
    found = {(i, j) for i, j, *_ in got(D.overlaps(documents(docs), spark.createDataFrame(items, "item_id bigint, text string")))}
    expected = {(i, j) for i, text in docs for j, item in items if path(tokens(text), t := tokens(item), D.SLACK) >= max(8, len(t) / 2)}
    assert len(straight) > 100 and straight <= expected and len(expected) > len(straight) + 30
    assert straight <= found
    assert found == expected
