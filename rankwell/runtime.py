"""Session helpers: where durable intermediate data goes, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for durable intermediates, as the cluster names it.

    Only a single-machine session (``local[...]``) that names no folder gets a temporary one; a cluster
    session without the setting is an error, because an executor's own disk is lost with the executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get(_CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so that every later use reads the same rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared location for a table written and read back within one job."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a scan has fewer splits than that; a table of many splits is left alone.

    Per-row text work on one small file would otherwise run in one task. At scale the scan has far more splits
    than cores and this adds nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The side of a join expected to be small, with a broadcast hint only when it has been measured to be.

    The side is made durable once, so measuring does not compute it twice. Beyond the limits it comes back
    without a hint and the join shuffles, with skewed keys split at run time.
    """
    kept = durable(df)
    width = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept.columns]))))
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(width, F.lit(0))).first()
    return F.broadcast(kept) if rows <= max_rows and size <= max_bytes else kept


ROWS_PER_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many partitions ``rows`` that are sorted or grouped need, so that a task's share doesn't grow with the table.

    Adaptive execution coalesces shuffled data by its compressed size, of which the rows in memory are a multiple.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch of what is written inside; the session's own number holds again after.

    A batch is held by the executor and by its Python worker, so rows with long texts need small ones.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: its job leaves a mark as the last thing."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
