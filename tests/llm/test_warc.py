import gzip
import hashlib
from pathlib import Path

import pytest

from rankwell.llm import warc as W
from rankwell.runtime import scratch_path

TRAP = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, record int, digest string")


def rows_of():
    long = "é\U0001f600<p>" * 900
    return [
        (1, "http://a/1", "short"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/\r\nX: y", long), (5, "http://a/5", long), (9, "http://a/9", long), (9, "http://a/9", long),
        (6, "http://a/6", TRAP * 3), (7, "http://a/7", TRAP * 40), (8, "http://a/8", TRAP * 40), (None, "http://a/n", long), (None, "http://a/m", "only" * 400), (None, "http://a/m", "only" * 400),
        (10, "http://a/10", "\r\n\r\n"), (11, "u", "x" * 999 ), (12, "u", "x" * 999), (13, "u", "y" * 1000), (14, "u", "y" * 1000), (15, "u", "ends with\r\n\r\nWA"),
    ]


def expected(rows):
    tops, out = {}, []
    for i, _, html in rows:
        if i is not None:
            tops[html or ""] = max(i, tops.get(html or "", i))
    for i, _, html in rows:
        data, top = (html or "").encode(), tops.get(html or "")
        revisit = len(data) >= 1000 and top is not None and i != top
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [W.CHUNK, 50])
def test_round_trip(spark, chunk):
    path = scratch_path(spark, "warc")
    W.write_archive(pages(spark, rows_of()), path, chunk=chunk)
    assert sorted(map(tuple, W.read_pages(spark, path).collect()), key=repr) == expected(rows_of())


def test_archives_parse_by_their_stated_lengths(spark):
    path = scratch_path(spark, "warc")
    W.write_archive(pages(spark, rows_of()), path, chunk=500)
    payloads, kinds, ids = {}, [], []
    for file in Path(path.removeprefix("file:")).glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            block, end, data = rest[:size], rest[size : size + 4], rest[size + 4 :]
            assert end == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            if fields["WARC-Type"] == "response":
                block = block.partition(b"\r\n\r\n")[2]
                ids.append((fields["WARC-Record-ID"], fields.get("X-Page-ID")))
            if fields["WARC-Type"] != "revisit" and fields.get("X-Page-ID") == "9":
                payloads[int(fields.get("WARC-Segment-Number", 1))] = block
    assert b"".join(v for _, v in sorted(payloads.items())).decode() == rows_of()[5][2]
    assert {"response", "continuation", "revisit"} == set(kinds)
    assert all(len({i for i, p in ids if p == page}) == 1 for _, page in ids if page)


def test_incremental_digests_span_batches(spark):
    parts = [(r, n, 7, bytes([r, n]) * (n * 1000)) for r in (1, 2) for n in range(7)]
    df = spark.createDataFrame([(f"r{r}", n, k, c) for r, n, k, c in [*parts, parts[3]]], "record string, number int, n_chunks int, chunk binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {tuple(r) for r in W.digests(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {r: b"".join(c for q, _, _, c in parts if q == r) for r in (1, 2)}
    assert got == {(f"r{r}", hashlib.sha1(w).hexdigest(), len(w)) for r, w in whole.items()}


def test_empty_table(spark):
    path = scratch_path(spark, "warc")
    W.write_archive(pages(spark, []), path)
    assert W.read_pages(spark, path).count() == 0
