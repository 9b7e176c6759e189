"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, permuted, form a tape of words. Its target is a number of blocks of the tape, read again from
the start when it ends. A tree halves the multiset of all blocks again and again, each time by a multivariate
hypergeometric draw, until every output shard has its exact quota of each source; the shards then take disjoint runs of
the source's permuted blocks and order their blocks locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.common import n_plain_words
from rankwell.runtime import durable, small_side

WEIGHTS = (5, 2, 1)
REPEATS = 3
BUCKET = 50_000  # rows of a source whose running sum one task takes at a time


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, n_rows, source_size, target, take, total) per source of (source, size) rows.

    Sources in code-point order, null last, have the weights in turn and share all words. A target stops at ``repeats``
    times its source; the water level that fills the others is found by running sums in the order in which they fill
    up. The table of sources, one row each, is a dimension and passes through one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sums.withColumn("rank", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights)) + 1)).withColumn("cap", F.col("source_size") * float(repeats))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("total") - before("cap")) / (F.col("weights") - before("weight")))
    open_ = F.col("level") <= F.col("cap") / F.col("weight")
    level = F.coalesce(F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"], F.max(F.col("cap") / F.col("weight")).over(everything))
    rows = rows.withColumn("target", F.least("cap", level * F.col("weight")))
    take = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * repeats)
    return rows.select("source", "rank", "n_rows", "source_size", "target", take.cast("bigint").alias("take"), "total")


def _drawn(seed: int, *parts: str) -> Column:
    """A random order of rows that depends on the parts alone: 128 bits of a hash, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def split_blocks(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, rank, quota) for 2**levels shards, from (rank, blocks) per source: the splitting tree.

    A node holds its blocks per source. Its left child has half of them, the odd one included, drawn without
    replacement: the node's blocks stand in a random order of which the first half goes left, so the counts per source
    follow the multivariate hypergeometric law exactly. Only counts go down to the next level, where they are drawn
    anew. A level has as many rows as the mix has blocks, a parameter, whatever the size of the corpus.
    """
    nodes = quotas.where("blocks > 0").selectExpr("1L AS node", "rank", "blocks AS quota")
    inside = Window.partitionBy("node")
    for _ in range(levels):
        blocks = nodes.select("node", "rank", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("quota").cast("bigint"))).alias("nth"))
        blocks = blocks.withColumn("at", F.row_number().over(inside.orderBy(_drawn(seed, "node", "rank", "nth"), "rank", "nth"))).withColumn("n", F.count(F.lit(1)).over(inside))
        child = F.expr("2 * node + if(at <= n DIV 2 + n % 2, 0, 1)")
        nodes = blocks.groupBy(child.alias("node"), "rank").agg(F.count(F.lit(1)).alias("quota"))
    return nodes.select((F.col("node") - (1 << levels)).alias("shard"), "rank", "quota")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", levels: int = 4, blocks: int = 4096, seed: int = 7,
        weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The pieces of the mix, one row per document, reading and block that overlap; documents left out have one row
    with 0 words.

    Columns: doc_id, source, size, source_size, target, place (unique per row of ``docs``), shard, position (of the
    block in its shard), epoch (0 for the first reading), first_word, n_words. A source's pieces add up to its target,
    rounded to a word; no document is read more than ``repeats`` times. The order of a tape is that of a hash of id and
    text, so reruns agree; only ids, sources and counts are shuffled, never texts, and a source of any share of the
    rows is summed in many tasks.

    Null and empty texts have size 0 and are never taken. Null sources form one source, the last. Rows without an id
    take part; repeated rows are separate readings. An empty table gives an empty result; other columns are ignored.
    """
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text), F.lit(""))))
    sized = durable(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_plain_words(F.col(text)).alias("size"), key.alias("key")))
    goals = small_side(targets(sized, weights, repeats))

    # the tape: running word counts within buckets of the permuted order, then over buckets
    spread = sized.alias("d").join(goals.alias("g"), F.expr("d.source <=> g.source")).select("d.*", "rank", "source_size", "target", "take", "total", F.ceil(F.col("n_rows") / BUCKET).alias("buckets"))
    spread = spread.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") / 4294967296.0 * F.col("buckets")))
    offsets = spread.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(F.col("rank").alias("_rank"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "size")
    tape = spread.withColumn("nth", F.row_number().over(inside)).withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    tape = tape.join(offsets, (F.col("rank") == F.col("_rank")) & (F.col("bucket") == F.col("_bucket"))).withColumn("start", F.col("offset") + F.col("within"))
    tape = tape.withColumn("place", F.struct("rank", "bucket", "nth")).withColumn("width", F.greatest(F.lit(1), F.ceil(F.col("total") / blocks)))

    # shards of the blocks
    per_source = goals.select("rank", "take", F.greatest(F.lit(1), F.ceil(F.col("total") / blocks)).alias("width")).select("rank", F.ceil(F.col("take") / F.col("width")).alias("blocks"))
    shards = split_blocks(per_source, levels, seed)
    runs = shards.withColumn("end", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))).select(F.col("rank").alias("r"), "shard", F.col("end") - F.col("quota") + 1, "end").toDF("r", "shard", "begin", "end")
    permuted = Window.partitionBy("rank").orderBy(_drawn(seed, "rank", "block"), "block")
    drawn = per_source.where("blocks > 0").select("rank", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn("at", F.row_number().over(permuted))
    drawn = drawn.join(runs, F.expr("rank = r AND at BETWEEN begin AND end"))
    local = Window.partitionBy("shard").orderBy(_drawn(seed + 1, "shard", "rank", "block"), "rank", "block")
    drawn = drawn.select(F.col("rank").alias("_r"), F.col("block").alias("_b"), "shard", (F.row_number().over(local) - 1).alias("position"))

    readings = F.expr(f"""filter(transform(sequence(0, {repeats - 1}), e -> named_struct('epoch', e, 'at', e * source_size + start, 'to', least(take, e * source_size + start + size))),
                             r -> r.at < r.to)""")
    pieces = tape.select("doc_id", "source", "size", "source_size", "target", "place", "rank", "width", F.explode_outer(readings).alias("r"))
    spans = F.expr("if(r IS NULL, cast(array() AS array<bigint>), sequence(r.at DIV width, (r.to - 1) DIV width))")
    pieces = pieces.select("*", F.explode_outer(spans).alias("block"))
    low, high = F.greatest(F.col("r.at"), F.col("block") * F.col("width")), F.least(F.col("r.to"), (F.col("block") + 1) * F.col("width"))
    pieces = pieces.join(small_side(drawn), F.expr("rank = _r AND block = _b"), "left")
    return pieces.select(
        "doc_id", "source", "size", "source_size", "target", "place", "shard", "position", F.col("r.epoch").alias("epoch"),
        (low - F.col("r.at")).alias("first_word"), F.coalesce(F.when(F.col("shard").isNotNull(), high - low), F.lit(0)).cast("bigint").alias("n_words"),
    )


def by_document(pieces: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_shards, n_pieces, spans_sha256) per row that ``mix`` was given.

    The digest is that of ``shard:position:epoch:first_word:n_words`` of every piece, by epoch and first word, joined by
    commas. A row has at most ``repeats`` times (its blocks + 1) pieces, which the number of blocks of the mix bounds.
    """
    span = F.struct("epoch", "first_word", F.concat_ws(":", "shard", "position", "epoch", "first_word", "n_words").alias("s"))
    per_doc = pieces.groupBy("place", "doc_id", "size", "source_size", "target").agg(
        F.sum("n_words").alias("taken"), F.count_distinct("shard").alias("n_shards"), F.count("shard").alias("n_pieces"),
        F.sort_array(F.collect_list(F.when(F.col("shard").isNotNull(), span))).alias("spans"),
    )
    return per_doc.select("doc_id", "size", "source_size", "target", "taken", "n_shards", "n_pieces", F.sha2(F.array_join("spans.s", ","), 256).alias("spans_sha256"))
