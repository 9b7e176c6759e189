"""Near-duplicate groups by circulant MinHash, banding and exact verification.

Two permutations make every signature coordinate: the first scatters a text's shingles over Z/2^32, the second, shifted
circularly by k, gives coordinate k as the smallest image. Bands of coordinates propose pairs, the full shingle sets
decide them, and the components of the confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.common import WordHashes, connected_components, free_name
from rankwell.runtime import durable, small_side

BANDS, ROWS = 32, 5
SMALL = 10 << 20  # bytes of shingle sets up to which they are broadcast, as in a join of Spark's own
DIRECT = 16  # classes in a bucket whose components are compared pair by pair
PAIRS = 3  # per class of the corpus, up to which all pairs left are compared directly
DEPTH = 4  # times that large buckets are made finer; what is left then is compared pair by pair
BLOCK = 512  # shingles whose coordinates are computed at a time
SLICE = 500  # texts that a task holds as Python objects, of an Arrow batch that may have 10,000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
_ROW_FACTORS = np.array([pow(0xD6E8FEB86659FD93, ROWS - i, 1 << 64) for i in range(ROWS)], np.uint64)


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x85EBCA6B)
    np.right_shift(x, np.uint32(13), out=t)
    x ^= t
    x *= np.uint32(0xC2B2AE35)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z lower-cased: what splitting bytes does."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words, of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for i in range(min(len(h), size)):
        out = _mix64(out * _STEP + h[i : i + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k is the smallest second permutation of (first permutation + k) over the shingles."""
    placed = _mix32((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32))
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(placed), BLOCK):
        np.minimum(best, _mix32(placed[None, at : at + BLOCK] + _SHIFTS).min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    mixed = (_mix64(rows + np.uint64(1)) * _ROW_FACTORS).sum(axis=1, dtype=np.uint64)
    return _mix64(mixed + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64, copy=False)))


def _class(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, a few at a time; an empty batch has none."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, none = WordHashes(), np.empty(0, np.int64)
        for batch in _slices(batches):
            classes, counts, bands = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                shingles = shingle_set(words, hashes, size)
                classes.append(_class(words))
                counts.append(len(shingles))
                bands.append(band_keys(signature(shingles)) if words else none)
            columns = [batch.column("doc_id"), batch.column("same"), pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), _lists(bands)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "same", "class", "n_shingles", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _slices(batches):
            words = [words_of(text) for text in batch.column("text").to_pylist()]
            sets = [shingle_set(w, hashes, size).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(map(_class, words), pa.binary()), _lists(sets)], ["class", "shingles"])

    return run


def _sets_of(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(class, shingles) of the classes in (class, same) rows, made anew from one text of each; for a broadcast if small."""
    wanted = small_side(members.select("same").distinct())
    found = texts.join(wanted, "same", "left_semi").dropDuplicates(["same"])
    sets = durable(found.select("text").mapInArrow(_sets(size), "class binary, shingles array<bigint>"))
    size_of = sets.agg(F.sum(8 * F.size("shingles") + 64)).first()[0] or 0
    return F.broadcast(sets) if size_of <= SMALL else sets


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    ends = pairs.select(F.explode(F.array(F.col("same_a"), F.col("same_b"))).alias("same"))
    sets = _sets_of(ends, texts, size)
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    checked = both.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return checked.where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("total") - F.col("shared"))).select("a", "b")


def _pairs(x: DataFrame, y: DataFrame, on: str, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components whose sizes allow the similarity."""
    fits = f"x.component != y.component AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    joined = x.alias("x").join(y.alias("y"), F.expr(f"{on} AND {fits}"))
    return joined.selectExpr("least(x.class, y.class) AS a", "greatest(x.class, y.class) AS b")


def _candidates(rows: DataFrame, same: DataFrame, texts: DataFrame, size: int, percent: int, most: float) -> DataFrame:
    """Pairs of different components that may be similar, among classes in a bucket (key, class, n, degree, component).

    ``same`` gives a text of each class. Where components meet in a bucket, their classes are paired directly, if that
    makes no more than ``most`` pairs in all or the bucket is small. Else, two sets x and y share at most
    min(|x & leader|, |y & leader|) within the leader of the bucket, the class of the highest degree (at first, that which
    leads this one elsewhere, so that most buckets of a group have one leader). If that can suffice, they meet by their
    sizes; if not, they must share shingles outside the leader, and meet in a bucket of one of these, of which the first
    few in the common order, the rarest, will do (prefix filter). Finer buckets are treated likewise.
    """
    pairs = None
    for depth in range(DEPTH + 1):
        met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lowest"), F.max("component").alias("highest"), F.max(F.struct("degree", "class")).alias("l"))
        rows = durable(rows.join(met.where("lowest != highest").select("key", "m", "l"), "key"))
        last = depth == DEPTH or (rows.agg(F.sum((F.col("m") - 1) / 2)).first()[0] or 0) <= most
        direct = rows if last else rows.where(f"m <= {DIRECT}")
        direct = _pairs(direct, direct, "x.key = y.key AND x.class < y.class", percent)
        pairs = direct if pairs is None else pairs.union(direct)
        if last:
            return pairs.distinct()

        members = rows.where(f"m > {DIRECT}").withColumn("lead", F.col("l.class"))
        if depth == 0:  # a pair may share many bands, but needs to be looked at once per leader
            heads = members.groupBy("class").agg(F.max("l").alias("top")).select(F.col("class").alias("lead"), F.col("top.class").alias("top"))
            members = members.join(heads, "lead").withColumn("lead", F.col("top")).withColumn("key", F.xxhash64("top"))
        members = members.select("key", "class", "n", "degree", "component", "lead").distinct()
        members = durable(members)
        bounds = members.groupBy("key").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        sets = _sets_of(members.select("class").union(members.select("lead")).distinct().join(same, "class"), texts, size)
        seen = members.join(sets, "class").join(sets.select(F.col("class").alias("lead"), F.col("shingles").alias("lead_set")), "lead")
        held, rest = F.size(F.array_intersect("shingles", "lead_set")).alias("c"), F.array_except("shingles", "lead_set").alias("rest")
        seen = seen.select("key", "class", "n", "degree", "component", held, rest).join(bounds, "key")
        seen = durable(seen.withColumn("low", F.expr(f"greatest(low, ({percent} * n + 99) DIV 100)")).withColumn("high", F.expr(f"least(high, 100 * n DIV {percent})")))

        reach = seen.withColumn("high", F.expr(f"least(high, {100 + percent} * c DIV {percent} - n)")).where("low <= high").drop("rest")
        reach = reach.select("*", F.explode(F.sequence("low", "high")).alias("other"))
        pairs = pairs.union(_pairs(reach, seen.drop("rest", "low", "high"), f"x.key = y.key AND x.other = y.n AND {100 + percent} * y.c >= {percent} * (x.n + y.n)", percent))

        need = F.expr(f"greatest(1, ({percent} * (n + low) + {99 + percent}) DIV {100 + percent} - c)").alias("need")
        spread = seen.select("key", "class", "n", "degree", "component", need, F.size("rest").alias("size"), F.explode("rest").alias("z")).where("need <= size")
        spread = spread.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("key", "z")))
        spread = spread.withColumn("place", F.row_number().over(Window.partitionBy("key", "class").orderBy("often", "z"))).where("often > 1 AND place <= size - need + 1")
        rows = durable(spread.select(F.xxhash64("key", "z").alias("key"), "class", "n", "degree", "component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    A text's set holds its distinct ``shingle``-word sequences, or its whole sequence when it is shorter. Texts whose
    sets have ``percent`` of their union in common are linked; confirmation uses the full sets. ``component_id`` is the
    smallest id reachable and ``kept`` marks the row that bears it.

    Texts equal as word sequences form one class from the start, so a group of copies costs one signature in all later
    steps. In each bucket of a band every class is first compared with one leader, the class that shares most buckets
    with others; classes of different components left in one bucket are then compared where their overlap can suffice
    (see ``_candidates``), so a group of near copies never meets all its pairs, and no link between components is lost.
    Banding misses a pair at the threshold with a probability below 1e-5.

    Null and empty texts, and texts of blanks, have no words: 0 shingles, linked with nothing. Rows without an id get
    the component of their text and are kept only if no row of the component has one. Repeated rows are linked to each
    other and share their id. An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(text).alias("same"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    rows = durable(base.mapInArrow(_sign(shingle), f"doc_id {id_type}, same string, class binary, n_shingles bigint, bands array<bigint>"))
    texts = base.select("same", "text")

    classes = durable(
        rows.where("class IS NOT NULL").groupBy("class").agg(F.min("same").alias("same"), F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    banded = classes.select("class", "n", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = banded.join(crowded, "key")
    hubs = shared.groupBy("class").agg(F.sum("m").alias("degree"))
    shared = durable(shared.join(hubs, "class").join(classes.select("class", "same"), "class").select("key", "class", "same", "n", "degree"))

    leaders = shared.groupBy("key").agg(F.max(F.struct("degree", "class", "same", "n")).alias("l"))
    close = f"class != l.class AND 100 * least(n, l.n) >= {percent} * greatest(n, l.n)"
    star = shared.join(leaders, "key").where(close)
    star = star.select(F.col("class").alias("a"), F.col("l.class").alias("b"), F.col("same").alias("same_a"), F.col("l.same").alias("same_b")).distinct()
    found = durable(connected_components(_confirm(durable(star), texts, shingle, percent), "a", "b"))

    labelled = shared.join(found.withColumnRenamed("node", "class"), "class", "left").select("key", "class", "n", "degree", F.coalesce("component", "class").alias("component"))
    same = classes.select("class", "same")
    pairs = durable(_candidates(labelled, same, texts, shingle, percent, PAIRS * classes.count()))
    pairs = pairs.join(same.toDF("a", "same_a"), "a").join(same.toDF("b", "same_b"), "b")
    more = _confirm(durable(pairs), texts, shingle, percent)
    # components are joined by the links between them
    a, b = found.toDF("a", "of_a"), found.toDF("b", "of_b")
    joined = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = durable(connected_components(joined, "a", "b").toDF("component", "wider"))
    labels = found.select(F.col("node").alias("class"), "component")
    alone = joined.join(labels, F.col("class") == joined["component"], "left_anti").select(F.col("component").alias("class"), "component")
    components = labels.union(alone).join(joined, "component", "left").select("class", F.coalesce("wider", "component").alias("component"))

    members = classes.select("class", "first_id").join(components, "class", "left")
    members = members.select("class", "first_id", F.coalesce("component", "class").alias("component"))
    smallest = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = members.join(smallest, "component").select("class", "component_id")
    out = rows.select("doc_id", "class", "n_shingles").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are near copies of a row with a smaller id; all columns stay, whatever they are called.

    Rows without an id, and null and empty texts, stay; repeated rows of one id stay or go together. An empty table stays empty.
    """
    gone = free_name(docs.columns, "_gone")
    copies = near_duplicates(docs, doc_id, text, shingle, percent).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(copies, F.col(doc_id) == F.col(gone), "left_anti")
