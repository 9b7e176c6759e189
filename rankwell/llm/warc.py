r"""WARC archives as a chunked record table.

A payload is a run of rows (record, chunk number, chunk). In an archive each row is a record of its own: the first a
response, the others continuations, as the format's segmentation has it. Digests of payloads in several chunks are
carried from chunk to chunk, so that no task ever holds such a payload whole.

Spark writes and reads the archives as text files whose separator is the blank lines between records, so output is
committed like any other and works on every file system that Spark knows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.runtime import durable, small_side

CHUNK = 1 << 20  # characters
LEAST_REVISIT = 1000  # bytes
# The first line of a record, and what ends one.
VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"


def chunks_of(text: Column, size: int = CHUNK) -> Column:
    """The chunks of a text. A line that would read as the start of a record is cut in two, so none holds it whole."""
    whole = F.split(text, "(?<=\r\n\r\nWA)(?=RC/1\\.1\r\n)")
    return F.flatten(F.transform(whole, lambda p: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int"))), lambda i: F.substring(p, i * size + 1, F.lit(size))
    )))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and length per record from its chunks, which arrive in order."""
    key, state, size = None, None, 0
    done: list[tuple[str, str, int]] = []
    for batch in batches:
        for record, chunk in zip(batch.column("record").to_pylist(), batch.column("chunk"), strict=True):
            if record != key:
                if key is not None:
                    done.append((key, state.hexdigest(), size))
                key, state, size = record, hashlib.sha1(usedforsecurity=False), 0
            data = chunk.as_buffer()
            state.update(data)
            size += data.size
        yield _rows(done)
        done = []
    if key is not None:
        yield _rows([(key, state.hexdigest(), size)])


def _rows(done: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["record", "digest", "bytes"])


def digests(chunks: DataFrame) -> DataFrame:
    """(record, digest, bytes) of a chunk table (record, number, n_chunks, chunk): hex SHA-1 and length of each payload.

    Records of one chunk are digested where they stand; the chunks of others meet in order in one task, which holds a
    batch of chunks at a time. Repeated chunks count once, rows without a record are left out; an empty table gives an
    empty result.
    """
    known = chunks.where("record IS NOT NULL").select("record", "number", "n_chunks", F.col("chunk").cast("binary").alias("chunk"))
    single = known.where("n_chunks = 1").select("record", F.sha1("chunk").alias("digest"), F.octet_length("chunk").cast("bigint").alias("bytes")).distinct()
    long = known.where("n_chunks > 1").dropDuplicates(["record", "number"])
    long = long.repartition("record").sortWithinPartitions("record", "number").select("record", "chunk")
    return single.union(long.mapInArrow(_fold, "record string, digest string, bytes bigint"))


def _identifier(page_id: Column, digest: Column, *more: Column) -> Column:
    """A record identifier made from what identifies the record, so that a task run again writes the same."""
    hexes = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest, *more))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK, date: str = "2026-01-01T00:00:00Z") -> None:
    """Writes a record per page to gzip-compressed archives in the folder ``path``.

    Of pages with equal payloads of at least 1000 bytes, that with the largest id is a response, the others are revisits
    that refer to it; all other pages are responses. Pages without an id revisit one with an id, and are responses where
    there is none; repeated rows of the largest id are all responses. A null html is an empty payload; a null url leaves
    out the address. An empty table writes no record.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text.alias("text"))
    # A payload of one chunk is digested where it stands; others are known by a digest of their text until theirs is made.
    long = (F.length("text") > chunk) | F.contains("text", F.lit(END + VERSION))
    rows = rows.withColumn("long", long)
    rows = rows.withColumn("key", F.when(F.col("long"), F.md5("text")).otherwise(F.sha1(F.col("text").cast("binary")))).withColumn("bytes", F.octet_length("text").cast("bigint"))
    table = rows.where("long").select(F.col("key").alias("record"), chunks_of(F.col("text"), chunk).alias("chunks"))
    table = table.select("record", F.size("chunks").alias("n_chunks"), F.posexplode("chunks").alias("number", "chunk"))
    known = durable(digests(table)).select("record", "digest")
    # Payloads that are repeated or long: while these are few, no text needs to be shuffled.
    counted = rows.groupBy("key", "bytes", "long").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    top = F.when((F.col("n") > 1) & (F.col("bytes") >= LEAST_REVISIT), F.col("top"))
    special = counted.select(F.col("key").alias("record"), top.alias("top"), "long").where("long OR top IS NOT NULL").drop("long").join(known, "record", "left")

    full = rows.join(small_side(special), F.col("key") == F.col("record"), "left").withColumn("digest", F.coalesce("digest", "key"))
    full = full.withColumn("revisit", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")))
    full = full.withColumn("origin", _identifier(F.col("page_id"), F.col("digest")))
    pieces = F.when(F.col("revisit"), F.array(F.lit(""))).when(~F.col("long"), F.array("text")).otherwise(chunks_of(F.col("text"), chunk))
    parts = full.withColumn("pieces", pieces).select("page_id", "url", "digest", "bytes", "top", "revisit", "origin", F.size("pieces").alias("n"), F.posexplode("pieces").alias("number", "piece"))

    first = F.col("number") == 0
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    only = lambda condition, value: F.when(condition, value.cast("string"))
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    many = F.col("n") > 1
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), "").otherwise(F.concat(F.when(first, head).otherwise(""), F.col("piece")))
    record = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, F.col("origin")).otherwise(_identifier(F.col("page_id"), F.col("digest"), F.col("number").cast("string")))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", address), line("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", only(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", only(F.col("revisit"), _identifier(F.col("top"), F.col("digest")))), line("X-Refers-To-Page", only(F.col("revisit"), F.col("top"))),
        line("WARC-Segment-Number", only(many, F.col("number") + 1)), line("X-Segments", only(many, F.col("n"))),
        line("WARC-Segment-Origin-ID", only(many & ~first, F.col("origin"))),
        line("WARC-Segment-Total-Length", only(many & (F.col("number") + 1 == F.col("n")), F.col("bytes") + F.octet_length(head))),
        line("Content-Type", F.when(F.col("revisit") | first, "application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    parts.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The record table of archives: type, record, page_id, refers_to, refers_to_record, number, n_chunks, chunk.

    A chunk is the part of the payload that the record holds, without the head of the response. A record whose length
    isn't the stated one is an error.
    """
    lines = spark.read.option("lineSep", END + VERSION).text(path).where("value <> ''")
    begin = F.instr("value", END)
    cut = lines.select(F.regexp_replace(F.substring(F.col("value"), F.lit(1), begin + 1), "^WARC/1\\.1\r\n", "").alias("head"), F.substring(F.col("value"), begin + 4, F.length("value")).alias("rest"))
    field = lambda name: F.nullif(F.regexp_extract("head", f"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))
    size = field("Content-Length").cast("int")
    fields = cut.select(
        field("WARC-Type").alias("type"), F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"), field("X-Page-ID").cast("bigint").alias("page_id"),
        field("X-Refers-To-Page").cast("bigint").alias("refers_to"), field("WARC-Refers-To").alias("refers_to_record"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("number"), F.coalesce(field("X-Segments").cast("int"), F.lit(1)).alias("n_chunks"),
        F.when(F.octet_length("rest") >= size, F.substring(F.col("rest").cast("binary"), F.lit(1), size)).otherwise(F.raise_error(F.lit("a record is shorter than stated")).cast("binary")).alias("block"),
    )
    opened = F.col("block").cast("string")
    chunk = F.when(F.col("type") == "response", F.substring(opened, F.instr(opened, END) + 4, F.length(opened)).cast("binary")).otherwise(F.col("block"))
    return fields.withColumn("chunk", chunk).drop("block")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per page of the archives.

    Digest and length are those of the payload as read; a revisit has those of the response it refers to.
    """
    records = read_archive(spark, path)
    held = durable(digests(records.where("type <> 'revisit'").select("record", "number", "n_chunks", "chunk")))
    heads = records.where("type <> 'continuation'").select("page_id", "type", "refers_to", F.coalesce("refers_to_record", "record").alias("holder"))
    return heads.join(held, F.col("holder") == F.col("record"), "left").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )
