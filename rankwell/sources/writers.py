"""Writing chunk tables, rankings and flag logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def write_chunk_table(chunks: DataFrame, base: str, version: int) -> str:
    """Text and vectors of all chunks in one table, partitioned by role, under a new version folder.

    Both live in the same row, so they cannot differ in number; a chunk without a vector fails the job.
    Earlier versions stay as they are.
    """
    whole = F.assert_true(F.col("embedding").isNotNull(), F.concat(F.lit("no vector for chunk "), F.col("chunk_id").cast("string")))
    path = f"{base.rstrip('/')}/version={version}"
    chunks.filter(whole.isNull()).write.partitionBy("role").mode("errorifexists").parquet(path)
    return path


def read_chunk_table(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """A version of the chunk table, by default the latest that has been written to its end; others aren't touched."""
    base = base.rstrip("/")
    if version is None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(base)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        done = lambda p: store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        found = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("version=")]
        version = max((int(p.getName().removeprefix("version=")) for p in found if done(p)), default=None)
        if version is None:
            raise FileNotFoundError(f"no complete version in {base}")
    return spark.read.parquet(f"{base}/version={version}")


def save_bucketed_chunks(chunks: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Text and vectors of all chunks as a table of the catalog at ``path``, bucketed and sorted by candidate.

    What groups, ranks or caps the chunks of a candidate then needs no exchange of them: the scan already has each
    candidate in one task. Choose ``buckets`` for the size of the table, a few hundred MB to each. A chunk without a
    vector fails the job; an existing table of that name stays and is an error. Sessions with a shared catalog find the
    table by its name.
    """
    whole = F.assert_true(F.col("embedding").isNotNull(), F.concat(F.lit("no vector for chunk "), F.col("chunk_id").cast("string")))
    rows = chunks.filter(whole.isNull()).repartition(buckets, "candidate_id")  # one file to a bucket
    rows.write.bucketBy(buckets, "candidate_id").sortBy("candidate_id", "chunk_id").option("path", path).mode("errorifexists").saveAsTable(table)
    return chunks.sparkSession.table(table)


def export_ranked(ranked: DataFrame, req_scores: DataFrame, summary: DataFrame, base: str) -> None:
    """Per role: one summary record and one record per candidate with its requirement breakdown, as JSON.

    A candidate's breakdown is as long as its role has requirements; candidates are never gathered per role. Only the
    roles given are replaced; what is stored of other roles stays.
    """
    rows = req_scores.groupBy("role", "candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("req_id", "sub_score_sum", "n_sq", "contribution"))).alias("reqs")
    )
    ranked.join(rows, ["role", "candidate_id"], "left").write.partitionBy("role").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{base}/rankings")
    summary.write.partitionBy("role").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{base}/summary")


# The keys of a flag that a caller's extra keys neither replace nor stand in for.
CORE_FLAG_KEYS = [
    "flag_type", "timestamp", "candidate_id", "role", "req_id", "requirement_name", "sub_query_keys", "sub_query_count", "theta", "chunker",
]


def merge_extra(flags: DataFrame) -> DataFrame:
    """Adds the caller's extra keys to the flag's fields; they never replace a core key, nor fill one the flag lacks.

    ``flags``: candidate_id, role, flag_type, timestamp, any of the other core columns, and extra map<string,string>.
    Arrays become JSON.
    """

    def written(name: str) -> Column:
        return F.to_json(name) if isinstance(flags.schema[name].dataType, ArrayType) else F.col(name).cast("string")

    core = F.create_map(*[x for c in CORE_FLAG_KEYS if c in flags.columns for x in (F.lit(c), written(c))])
    extra = F.map_filter(
        F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(CORE_FLAG_KEYS)
    )
    return flags.withColumn("fields", F.map_concat(core, extra)).drop("extra")


def append_flags(flags: DataFrame, path: str) -> None:
    """Appends flag rows to the JSON lines log."""
    merge_extra(flags).write.mode("append").json(path)
