r"""License scans by an exact set-similarity join of stretches of words with license notices.

A block is any stretch of as many words as a notice has, over line ends, wherever it starts. It matches if words of the
notice stand in it in the notice's order, at least a given share of them (their longest common subsequence), if it holds
the notice's telling words (versions, "lesser", "nc"), and none that tell its siblings. Of a notice of ``n`` words,
``need`` of which must match, at least one of any ``n - need + 1`` words matches; the rarest in the corpus are looked up
(prefix filter). A match that puts word ``q`` of the notice at word ``i`` of the block leaves at most ``n - |i - q|``
matching words, so that a looked-up word allows few starts (positional filter of both sides). Stretches with fewer
than ``need`` words of the vocabulary go unseen (length filter); what is left is verified.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import NOT_ALNUM
from rankwell.runtime import scratch_path, small_side

# The phrases of the base and the label each stands for.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices as public licenses word them, and the label each stands for.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
    " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
    " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu lesser general public license version 2 1": "lgpl-2.1",
    "licensed under the gnu lesser general public license version 3": "lgpl-3",
    "licensed under the gnu affero general public license version 3": "agpl-3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
    " either version 2 of the license or at your option any later version": "gpl-2",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
    " either version 3 of the license or at your option any later version": "gpl-3",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"
    " either version 2 1 of the license or at your option any later version": "lgpl-2.1",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"
    " either version 3 of the license or at your option any later version": "lgpl-3",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"
    " either version 3 of the license or at your option any later version": "agpl-3",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under the bsd 2 clause license": "bsd-2",
    "licensed under the bsd 3 clause license": "bsd-3",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission": "bsd-3",
}

# The words that tell licenses of one family apart. A block must hold those of its notice and none of the others.
TELLING = [
    (("gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3"), ("2", "3", "affero", "lesser")),
    (("cc-by", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"), ("nc", "nd", "sa")),
    (("bsd-2", "bsd-3"), ("2", "3")),
]

# Words of a notice that are compared at once, as the bits of a bigint; longer notices are cut into equal parts.
PART = 60


def _joined(text: Column) -> Column:
    """The words, A-Z lower-cased, each between single blanks, with a blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), NOT_ALNUM, " ")), F.lit(" "))


def _base(words: str) -> tuple[Column, Column, Column, Column]:
    """Places of all phrases, the first and the last start, and the distinct labels, of a `` a b c `` column.

    A phrase's last word isn't its first, so its places don't overlap each other, and the blanks between words are
    only looked at.
    """
    counts, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        n = F.regexp_count(words, F.lit(f"(?<= ){phrase}(?= )"))
        before = F.size(F.split(F.substring_index(words, f" {phrase} ", 1), " ")) - 1
        # with the counter from the right, what stands before the last place is what its removal leaves
        head = F.regexp_extract(words, f"(?s)^(.* ){phrase} ", 1)
        counts.append(n)
        first.append(F.when(n > 0, before))
        last.append(F.when(n > 0, F.size(F.split(head, " ")) - 2))
        labels.append(F.when(n > 0, F.lit(label)))
    none = F.array_compact(F.array(*labels))
    return sum(counts[1:], counts[0]), F.array_min(F.array(*first)), F.array_max(F.array(*last)), none


def notice_parts(templates: dict[str, str], percent: int) -> list[tuple[str, list[str], int, list[str], list[str]]]:
    """(label, words, need, must, must_not) per notice, or per part of a notice longer than ``PART`` words."""
    parts = []
    for notice, label in sorted(templates.items()):
        words = [w for w in re.split(NOT_ALNUM, notice.lower()) if w]
        cuts = -(-len(words) // PART)
        for c in range(cuts):
            part = words[len(words) * c // cuts : len(words) * (c + 1) // cuts]
            telling = {w for labels, told in TELLING if label in labels for w in told}
            # a family's name alone (a part without any telling word) still excludes the siblings' words
            parts.append((label, part, max(1, -(-percent * len(part) // 100)), sorted(telling & set(part)), sorted(telling - set(part))))
    return parts


def _places(words: Column, vocabulary: list[str]) -> Column:
    """Where words of the vocabulary stand: (at, word) in the text's order."""
    if not vocabulary:
        return F.array().cast("array<struct<at:int,word:string>>")
    return F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word")))))


def matched_blocks(spark: SparkSession, texts: DataFrame, parts: list[tuple]) -> DataFrame:
    """(key, label, containment): the best containment per key and label of (key, places) rows.

    ``places`` holds where words of the parts' vocabulary stand, in order. Every block of every text takes part.
    """
    schema = "part int, label string, words array<string>, need int, must array<string>, must_not array<string>"
    notices = spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], schema)
    # the global order: occurrences over the whole corpus, rarest first
    held = texts.select(F.explode("places.word").alias("word")).groupBy("word").count()
    spelled = notices.select("*", F.posexplode("words").alias("q", "word")).join(held, "word", "left")
    ordered = spelled.groupBy("part", "label", "words", "need", "must", "must_not").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("frequency"), "word", "q"))).alias("o")
    )
    # a word's bits: the places of the notice at which it stands
    bits = F.expr("map_from_entries(transform(array_distinct(words), w -> struct(w, aggregate(sequence(0, size(words) - 1), 0L, (b, i) -> b | IF(words[i] = w, shiftleft(1L, i), 0L)))))")
    prefix = ordered.select("label", "need", "must", "must_not", F.size("words").alias("n"), bits.alias("bits"), F.expr("inline(slice(o, 1, size(words) - need + 1))"))
    prefix = small_side(prefix.drop("frequency"))

    spots = texts.select("key", "places", F.posexplode_outer("places").alias("k", "place"))
    hits = spots.withColumn("word", F.col("place.word")).join(prefix, "word")
    hits = hits.select("key", "label", "n", "need", "must", "must_not", "bits", (F.col("place.at") - F.col("q")).alias("s"), F.expr("slice(places, greatest(1, k + 2 - n), least(k + 1, n - 1) + n)").alias("near"))
    # repeated words of the notice count as often as they stand in it
    hits = hits.where("size(array_intersect(near.word, map_keys(bits))) >= need - n + size(bits) AND size(near) >= need")
    blocks = hits.withColumn("s", F.explode(F.expr("sequence(s - (n - need), s + (n - need))")))
    blocks = blocks.withColumn("block", F.expr("filter(near, x -> x.at >= s AND x.at < s + n)"))
    blocks = blocks.where("size(block) >= need AND NOT arrays_overlap(block.word, must_not) AND size(array_intersect(must, block.word)) = size(must)")
    # longest common subsequence by bits: those cleared are the notice's words matched so far
    cleared = "aggregate(transform(block, x -> coalesce(bits[x.word], 0L)), shiftleft(1L, n) - 1L, (v, m) -> ((v + (v & m)) | (v & ~m)) & (shiftleft(1L, n) - 1L))"
    scored = blocks.select("key", "label", "n", "need", (F.col("n") - F.expr(f"bit_count({cleared})")).alias("shared")).where("shared >= need")
    return scored.groupBy("key", "label").agg(F.max(F.col("shared") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    ``n_base`` counts all places of the base phrases; ``first_word`` and ``last_word`` are the smallest and largest
    start of one, null without any. ``labels`` adds to the base labels those of ``templates`` (notice to label) of which
    a block holds ``percent`` of the words in their order, with the family's telling words as the notice has them.
    ``score`` is the best share held by a block, 1 where a base phrase stands, else 0.

    Null texts count as empty: no words, no labels, score 0. Rows without an id come back too, repeated rows as often as
    given; an empty table gives an empty result; other columns are ignored. Texts are split once; what is shared
    afterwards is counts and the places of the notices' words. Rows are told apart by a number of their own, so that a
    text with many copies is no hot key.
    """
    spark = docs.sparkSession
    parts = notice_parts(templates, percent)
    vocabulary = sorted({w for _, words, _, must, must_not in parts for w in (*words, *must, *must_not)})
    least = min((p[2] for p in parts), default=1)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(_joined(F.col(text)), F.lit("  ")).alias("words"))
    n_places, first, last, labels = _base("words")
    n_words = F.when(F.col("words") == "  ", 0).otherwise(F.regexp_count("words", F.lit(" ")) - 1)
    places = _places(F.split(F.trim("words"), " "), vocabulary)
    read = rows.select("doc_id", n_words.alias("n_words"), n_places.alias("n_base"), first.alias("first_word"), last.alias("last_word"), labels.alias("base"), places.alias("places"))
    path = scratch_path(spark, "places")
    read.select("*", F.monotonically_increasing_id().alias("key")).write.parquet(path)
    read = spark.read.parquet(path)

    found = matched_blocks(spark, read.select("key", "places").where(F.size("places") >= least), parts) if parts else None
    more = spark.createDataFrame([], "key bigint, more array<string>, held double")
    if found is not None:
        more = found.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("held"))  # at most one per template label
    both = read.drop("places").join(more, "key", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("held", F.lit(0.0))).alias("score"),
    )
