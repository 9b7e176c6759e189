"""Benchmark decontamination by spaced-seed hashing.

A mask picks some of the tokens of a span and ignores the rest, so a substituted token at an ignored place leaves the
hash alone. Hashes of test items meet hashes of training texts in an equi-join; each hit fixes an alignment of item and
text, along which all tokens of the item are then compared, and next to which inserted and dropped words are looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import NOT_ALNUM, free_name
from rankwell.runtime import durable, small_side

MAX_SEEDS = 600_000  # of the items, up to which their hashes may be broadcast
# 1: the token counts, 0: it is ignored. These are all ways to pick three tokens of five, up to where they begin. If no
# five neighbours hold three equal ones, q fives and a rest of r tokens hold at most 2q + min(r, 2) equal ones, which is
# fewer than 8 or fewer than half: an alignment of 8 equal tokens and half of the tokens always has a hit.
MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
SPAN = 5
SLACK = 5  # the farthest that inserted or dropped words may move tokens from the alignment of a hit


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits; null for null."""
    return F.array_remove(F.split(F.lower(text), NOT_ALNUM), "")


def _spots(texts: DataFrame) -> DataFrame:
    """(key, pos, hash) for each text (key, words): one row per position and mask that fits there."""
    hashed = texts.where("words IS NOT NULL").select("key", F.expr("transform(words, w -> xxhash64(w))").alias("w0"))
    placed = hashed.selectExpr("key", "w0", *[f"slice(w0, {k + 1}, size(w0)) AS w{k}" for k in range(1, SPAN)])
    rows = placed.select("key", F.posexplode(F.arrays_zip(*[f"w{k}" for k in range(SPAN)])).alias("pos", "z")).where("z.w2 IS NOT NULL")
    hashes = [f"if(z.w{len(m) - 1} IS NULL, NULL, xxhash64({n}, " + ", ".join(f"z.w{k}" for k, bit in enumerate(m) if bit == "1") + "))" for n, m in enumerate(MASKS)]
    return rows.select("key", "pos", F.explode(F.expr(f"array({', '.join(hashes)})")).alias("hash"))


# Equal tokens of the best path from the item's first to its last token over the alignments within SLACK of
# ``first_word``, less one for each word by which it goes on to the next alignment.
_PATH = f"""aggregate(sequence(0, size(item) - 1), array_repeat(0, {2 * SLACK + 1}), (s, i) -> element_at(transform(
    array(transform(sequence(0, {2 * SLACK}), b -> greatest(s[b] + if(get(words, first_word - {SLACK} + b + i) <=> item[i], 1, 0), coalesce(get(s, b + 1) - 1, 0)))),
    t -> transform(sequence(0, {2 * SLACK}), b -> array_max(transform(sequence(0, b), c -> t[c] - b + c)))), 1), s -> array_max(s))"""
_EQUAL = "size(filter(sequence(0, size(item) - 1), i -> get(words, first_word + i) = item[i]))"
# At least the tokens of the item that stand anywhere in the text under these alignments.
_NEAR = f"slice(words, greatest(first_word - {SLACK}, 0) + 1, greatest(first_word + size(item) + {SLACK} - greatest(first_word - {SLACK}, 0), 0))"
_BOUND = f"size(item) - size(array_distinct(item)) + size(array_intersect(item, {_NEAR}))"


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
             least: int = 8, percent: int = 50) -> DataFrame:
    """(doc_id, item_id, first_word, n_compared, n_equal): the best alignment of each contaminating item in each text.

    An alignment counts if at least ``least`` tokens of the item are equal to the text's and these are at least
    ``percent`` of the item; substituted tokens are tolerated. ``first_word`` is the text's token under the item's first
    (negative where the text starts inside the item), ``n_compared`` the item's tokens that fall into the text. Of
    several alignments the one with most equal tokens is returned, then the earliest.

    An item that meets this along no single alignment counts as well if the path over neighbouring alignments does, as
    inserted and dropped words make it necessary; each such word costs one equal token. ``n_equal`` is then what is left
    and ``first_word`` the alignment from which the path strays at most ``SLACK`` words.

    With the defaults no alignment that counts is missed, however its unequal tokens lie. A path needs three equal
    tokens within five on one alignment; paths of one step always have them if over 8/14 of the item is equal. A smaller
    ``least`` or ``percent`` has no such guarantee. Texts and items that are null, empty or of fewer than ``least``
    tokens never match. Rows without an id are matched like others and come back with a null id; repeated rows come back as one.
    Equal texts are aligned once. Empty tables give an empty result; other columns are ignored.

    The items' hashes are broadcast if they are measured to be few; beyond that the join shuffles and the optimizer's
    run-time Bloom filter keeps positions that meet no item out of the shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(text).alias("key"))
    named = _overlaps_of_texts(docs.select(F.col(text).alias("text"), F.md5(text).alias("key")), items, item_id, item_text, least, percent)
    return rows.distinct().join(named, "key").drop("key")


def _overlaps_of_texts(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, least: int, percent: int) -> DataFrame:
    """The overlaps of texts (key, text), by key."""
    tests = items.select(F.col(item_id).alias("item_id"), F.md5(item_text).alias("item_key"), tokens(F.col(item_text)).alias("item"))
    known = _spots(tests.select(F.col("item_key").alias("key"), F.col("item").alias("words")).dropDuplicates(["key"]))
    known = small_side(known.select("hash", F.col("key").alias("item_key"), F.col("pos").alias("at")).where("hash IS NOT NULL"), max_rows=MAX_SEEDS)

    spots = _spots(rows.select("key", tokens(F.col("text")).alias("words")))
    hits = durable(spots.join(known, "hash").select("key", "item_key", (F.col("pos") - F.col("at")).alias("first_word")).distinct())

    wanted = small_side(hits.select("key").distinct())
    # Split before the grouping: a split above it would be worked out again for every hit and word.
    texts = rows.join(wanted, "key", "left_semi").select("key", tokens(F.col("text")).alias("words")).dropDuplicates(["key"])
    aligned = hits.join(small_side(tests.select("item_key", "item").dropDuplicates(["item_key"])), "item_key").join(texts, "key")
    compared = F.expr("least(size(words), first_word + size(item)) - greatest(0, first_word)")
    enough = lambda n: f"({n} >= {least} AND 100 * {n} >= {percent} * size(item))"
    # CASE works out the path only where the straight alignment isn't enough and the bound allows one; exploding keeps
    # the filter below from working it out again.
    bent = f"CASE WHEN {enough('n')} THEN -1 WHEN {enough('bound')} THEN {_PATH} ELSE 0 END"
    judged = F.expr(f"transform(array({_BOUND}), bound -> transform(array({{}}), n -> named_struct('n', n, 'bent', {bent}))[0])".replace("{}", _EQUAL))
    checked = aligned.select("key", "item_key", "first_word", compared.alias("n_compared"), F.size("item").alias("size"), F.explode(judged).alias("j"))
    checked = checked.select("key", "item_key", "first_word", "n_compared", "size", "j.n", "j.bent")
    good = checked.where(f"bent < 0 OR {enough('bent').replace('size(item)', 'size')}").selectExpr("key", "item_key", "first_word", "n_compared", "bent >= 0 AS strays", "if(bent < 0, n, bent) AS n_equal")
    best = good.groupBy("key", "item_key").agg(F.min(F.struct("strays", -F.col("n_equal"), "first_word", "n_compared", "n_equal")).alias("b"))
    return best.join(tests.select("item_key", "item_id").distinct(), "item_key").select("key", "item_id", "b.first_word", "b.n_compared", "b.n_equal")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 8, percent: int = 50) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item; all columns stay, whatever they are called.

    The text decides, not the id: contaminated rows without an id go, and of two texts under one id only the contaminated
    one. Null and empty texts stay, repeated rows stay or go together, an empty table stays empty.
    """
    key = free_name(docs.columns, "_gone")
    found = _overlaps_of_texts(docs.select(F.col(text).alias("text"), F.md5(text).alias("key")), items, item_id, item_text, least, percent)
    gone = small_side(found.select(F.col("key").alias(key)).distinct())
    return docs.join(gone, F.md5(F.col(text)) == F.col(key), "left_anti")
