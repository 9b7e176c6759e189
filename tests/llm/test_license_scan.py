import re

import pytest

from rankwell.llm import license_scan as L


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def in_order(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def best_share(w, notice, label, percent):
    """The best share of a notice in any stretch of as many words, 0 below the threshold; for notices of up to 60 words."""
    n, told = len(notice), {t for labels, ts in L.TELLING if label in labels for t in ts}
    own, best = told & set(notice), 0
    inside = [x in set(notice) for x in w]
    for s in range(1 - n, len(w)):
        a, z = max(s, 0), s + n
        if 100 * sum(inside[a:z]) < percent * n:  # can't hold that many of its words
            continue
        block = w[a:z]
        if own <= set(block) and not (told - own) & set(block):
            shared = in_order(block, notice)
            if 100 * shared >= percent * n:
                best = max(best, shared / n)
    return best


def brute(text, percent=80, templates=None):
    w = words(text)
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    more, best = set(), 0.0
    for notice, label in (L.TEMPLATES if templates is None else templates).items():
        whole = notice.split()
        halves = [whole] if len(whole) <= 60 else [whole[: len(whole) // 2], whole[len(whole) // 2 :]]
        share = max(best_share(w, half, label, percent) for half in halves)
        if share:
            more.add(label)
            best = max(best, share)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best)


MIT = next(n for n in L.TEMPLATES if n.startswith("permission is hereby"))
TEXTS = [
    "Under the MIT License, under  the mit\nlicense.", "cc by nc cc by nc CC-BY-NC", "under the mit license under the mit license", "Apache License, Version 2.0 of the mit",
    "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the\nGNU General Public License", "license public general gnu version 3 under the this is work licensed",
    "under the mitt license", "élicense under the mit license\x1c", "mit", " ", "Licensed under CC BY-SA 4.0.", "under the mit " * 50 + "license",
    "Redistribution and use in source and binary forms, with or without modification, are allowed", "Redistribution and use in source\nand binary forms, with or\nwithout modification, are permitted provided that the following conditions are met:",
    "license " * 3_000, "licensed under the gnu " * 400, MIT, MIT.replace("free of charge ", "").upper(), " ".join(MIT.split()[:30]), " ".join(reversed(MIT.split())), "the the the the the of of of of",
]
# what notices of one family, wrapped, changed or put out of order mean
MEANT = {
    "This library is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3",
    "Licensed under the GNU Lesser\nGeneral Public\nLicense version 2.1": "lgpl-2.1",
    "Licensed under the GNU Affero General Public License v. 3, version 3": "agpl-3",
    "This work is licensed under\nthe GNU General\nPublic License, version 2.": "gpl-2",
    "It is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "gpl-3",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License": "lgpl-2.1",
    "licensed under cc by nc 4.0": "cc-by-nc", "Licensed under CC BY 4.0": "cc-by", "licensed under cc by sa 4.0": "cc-by-sa", "licensed under cc by nc-sa 4.0": "cc-by-nc,cc-by-nc-sa",
    "version general license under gnu the public 3 licensed work this is": "", "4 0 sa by cc under licensed": "",
    "Licensed under the BSD-2-Clause License": "bsd-2", "licensed under the bsd 3-clause license": "bsd-3",
}


def test_equals_brute_force(documents, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate([*TEXTS, *MEANT])] + [(None, TEXTS[0]), (100, TEXTS[0])]
    out = L.scan(documents(rows))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)


def test_families_are_told_apart(documents):
    rows = list(enumerate(MEANT))
    got = {r.doc_id: r.labels for r in L.scan(documents(rows)).collect()}
    assert {t: got[i] for i, t in rows} == MEANT


@pytest.mark.parametrize("percent", [60, 100])
def test_other_thresholds(documents, percent):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *MEANT])]
    got = {r.doc_id: r.labels for r in L.scan(documents(rows), percent=percent).collect()}
    assert got == {i: brute(t, percent)[5] for i, t in rows}


def test_empty_table_and_no_templates(documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    assert L.scan(documents([])).count() == 0
    assert {r.labels for r in L.scan(documents(rows), templates={}).collect()} <= {"", "mit", "apache-2", "cc-by-nc"}
