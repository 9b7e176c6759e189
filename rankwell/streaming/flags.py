"""Counting audit flags as they arrive in the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.runtime import is_committed

FLAG_SCHEMA = "candidate_id long, role string, req_id long, flag_type string, timestamp timestamp, fields map<string,string>"

# What makes a flag a repetition of another one in the same window.
IDENTITY = ["candidate_id", "role", "req_id", "flag_type"]
GROUP = ["window_start", "window_end", "role", "flag_type"]


def read_flag_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(FLAG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _in_windows(flags: DataFrame, window: str, late: str) -> DataFrame:
    return flags.withWatermark("timestamp", late).withColumn("w", F.window("timestamp", window))


def _distinct(windowed: DataFrame) -> DataFrame:
    return windowed.dropDuplicates([*IDENTITY, "w"])


def _counted(windowed: DataFrame) -> DataFrame:
    counts = windowed.groupBy("w", "role", "flag_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "role", "flag_type", "n")


def flag_counts(flags: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Flags per role and type in tumbling windows of event time; works on a stream and on a table.

    Flags without a timestamp belong to no window and are not counted.
    """
    return _counted(_in_windows(flags, window, late))


def distinct_flag_counts(flags: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Like ``flag_counts``, but a candidate's flag of one type on one requirement counts once per window.

    Which of the repetitions came first makes no difference, so a stream and a table give the same counts. On a stream
    the state holds one key per distinct flag of the windows that are still open; the watermark closes them.
    """
    return _counted(_distinct(_in_windows(flags, window, late)))


def run_flag_counts(
    spark: SparkSession, source: str, target: str, checkpoint: str, window: str = "1 day", late: str = "1 hour", distinct: bool = True, files_per_trigger: int = 100
) -> None:
    """Process all flags present and bring the counts in ``target`` up to date.

    Each batch writes the counts that it changed, and only those, into a folder of its own; ``read_flag_counts`` takes the
    newest of each window. A batch repeated after a crash replaces its own folder. ``late`` says how far behind the
    newest flag seen before a flag may come and still count; a log that is replayed in no order needs a bound as long as
    its time span. A restart continues from the checkpoint, which must lie in the shared folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    counts = distinct_flag_counts if distinct else flag_counts
    query = (
        counts(read_flag_stream(spark, source, files_per_trigger), window, late)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    found = [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]
    return sorted(n for n in found if is_committed(spark, f"{folder}/{prefix}{n}"))


def read_flag_counts(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame:
    """The newest count of each window, role and type, from the last compaction and the batches after it.

    ``upto`` leaves out later batches. A target that nothing was written to has no rows.
    """
    batches = [b for b in _numbered(spark, target, "batch=") if upto is None or b <= upto]
    bases = [b for b in _numbered(spark, target, "upto=") if upto is None or b <= upto]
    base = bases[-1] if bases else -1
    parts = [(base, f"{target}/upto={base}")] if bases else []
    parts += [(b, f"{target}/batch={b}") for b in batches if b > base]
    schema = "window_start timestamp, window_end timestamp, role string, flag_type string, n long"
    whole = spark.createDataFrame([], f"{schema}, batch int")
    if parts:
        # one scan of all folders; the folder's number orders the rows
        number = F.regexp_extract(F.input_file_name(), "/(?:batch|upto)(?:=|%3D)([0-9]+)/[^/]*$", 1).cast("int")
        whole = spark.read.schema(schema).parquet(*[p for _, p in parts]).select("*", number.alias("batch"))
    return whole.groupBy(*GROUP).agg(F.max_by("n", "batch").alias("n"))


def compact_flag_counts(spark: SparkSession, target: str) -> None:
    """Writes the newest counts as one table, so that reading doesn't grow with the number of batches.

    The batches stay; what a stopped compaction leaves behind is not read. Run it between runs of the stream.
    """
    batches = _numbered(spark, target, "batch=")
    if batches:
        read_flag_counts(spark, target).write.mode("ignore").parquet(f"{target}/upto={batches[-1]}")
