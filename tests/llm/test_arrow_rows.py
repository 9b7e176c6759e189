"""Arrow batches of queries that write long texts are small, and the session keeps its own setting."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankwell.runtime import arrow_rows

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_are_small_inside_only(spark, tmp_path):
    @F.arrow_udf("int")
    def batch(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array([len(c)] * len(c), pa.int32())

    own = spark.conf.get(NAME)
    with arrow_rows(spark, 7):
        spark.range(0, 100, 1, 2).select(batch("id").alias("n")).write.parquet(f"{tmp_path}/t")
    assert spark.conf.get(NAME) == own
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert rows.count() == 100 and rows.agg(F.max("n")).first()[0] == 7
    with pytest.raises(ZeroDivisionError), arrow_rows(spark, 7):
        1 / 0
    assert spark.conf.get(NAME) == own
