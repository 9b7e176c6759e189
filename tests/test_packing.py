"""Paragraph packing against a plain fold, over texts of one and of many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from rankwell.functions import splitting as S


def packed(text, limit=S.PACK_CHARS, overlap=S.PACK_OVERLAP):
    body = text.strip()
    if len(body) <= limit:
        return [body] if body else []
    cur, out = "", []
    for para in filter(None, map(str.strip, body.split("\n\n"))):
        joined = f"{cur}\n\n{para}".strip() if cur else para
        if len(joined) <= limit:
            cur = joined
        elif cur:
            out.append(cur)
            cur = f"{cur[-overlap:]}\n\n{para}".strip()
        else:
            out.append(para[:limit])
            cur = para[limit - overlap :]
    return out + [cur] if cur else out


def pack(spark, texts, *args):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.p for r in df.select("id", S.pack_paragraphs(F.col("text"), *args).alias("p")).orderBy("id").collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 99, 100, 101, 2_000])
def test_blocks_of_pieces_join_to_the_whole(spark, n):
    text = "\n\n".join(f"p{i:05d} {'x' * 80}" for i in range(n))
    assert pack(spark, [text], 60, 10) == [packed(text, 60, 10)]


def test_equals_a_plain_fold(spark):
    r = random.Random(5)
    texts = ["\n\n".join("".join(r.choice("abé \n") for _ in range(r.choice([0, 3, 50, 700, 3000]))) for _ in range(k)) for k in (1, 2, 5, 40, 300)]
    assert pack(spark, [*texts, "", " \n\n "]) == [*map(packed, texts), [], []]
