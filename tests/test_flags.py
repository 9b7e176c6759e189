"""The flag log and its stream: repetitions, late flags, restarts."""

import datetime as dt
import os

from pyspark.sql import functions as F

from rankwell.sources import writers as W
from rankwell.streaming import flags as S

SCHEMA = "candidate_id long, role string, req_id long, flag_type string, timestamp timestamp, extra map<string,string>"


def flag(c, req, hour, day=1, kind="no_evidence", role="r"):
    return (c, role, req, kind, dt.datetime(2024, 5, day, hour, tzinfo=dt.timezone.utc), None)


def append(spark, rows, path):
    W.append_flags(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)


def rows(df):
    return sorted(map(tuple, df.select(*S.GROUP, "n").collect()), key=repr)


def batch_answer(spark, path, distinct=True):
    table = spark.read.schema(S.FLAG_SCHEMA).json(path)
    return rows((S.distinct_flag_counts if distinct else S.flag_counts)(table))


def test_repeated_and_late_flags_over_restarts_give_the_batch_answer(spark, tmp_path):
    log, target, check = str(tmp_path / "log"), str(tmp_path / "counts"), str(tmp_path / "check")
    run = lambda: S.run_flag_counts(spark, log, target, check, late="6 hours", files_per_trigger=1)

    append(spark, [flag(1, 1, 3), flag(1, 1, 9), flag(1, 2, 9), flag(None, None, 10), flag(None, None, 11)], log)
    run()
    first = rows(S.read_flag_counts(spark, target))
    assert first == batch_answer(spark, log) and [r[4] for r in first] == [3]

    append(spark, [flag(1, 1, 8), flag(2, 1, 7), flag(1, 1, 1, day=2), flag(1, 2, 23, kind="other"), flag(3, 1, 4, role="s")], log)
    run()
    assert rows(S.read_flag_counts(spark, target)) == batch_answer(spark, log)
    assert rows(S.read_flag_counts(spark, target, upto=0)) == first

    # the driver died after the sink had written and before the batch was committed: it is done again
    last = max(int(n) for n in os.listdir(f"{check}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{check}/commits/{name}"):
            os.remove(f"{check}/commits/{name}")
    append(spark, [flag(2, 1, 2, day=2), flag(1, 1, 2, day=2)], log)
    run()
    assert rows(S.read_flag_counts(spark, target)) == batch_answer(spark, log)

    whole = rows(S.read_flag_counts(spark, target))
    S.compact_flag_counts(spark, target)
    S.compact_flag_counts(spark, target)
    assert rows(S.read_flag_counts(spark, target)) == whole
    append(spark, [flag(4, 1, 3, day=2)], log)
    run()
    assert rows(S.read_flag_counts(spark, target)) == batch_answer(spark, log)


def test_a_batch_writes_only_what_it_changed_and_closed_windows_stay_closed(spark, tmp_path):
    log, target, check = str(tmp_path / "log"), str(tmp_path / "counts"), str(tmp_path / "check")
    run = lambda: S.run_flag_counts(spark, log, target, check, late="1 hour", files_per_trigger=1)
    append(spark, [flag(1, 1, 3), flag(1, 1, 3, day=9)], log)
    run()
    before = rows(S.read_flag_counts(spark, target))
    append(spark, [flag(2, 1, 4), flag(2, 1, 5, day=9)], log)  # the first lies more than an hour behind the newest
    run()
    after = rows(S.read_flag_counts(spark, target))
    assert [r[4] for r in before] == [1, 1] and [r[4] for r in after] == [1, 2]
    written = [r for b in S._numbered(spark, target, "batch=") if b for r in spark.read.parquet(f"{target}/batch={b}").collect()]
    assert [r.window_start.day for r in written] == [9]


def test_counts_without_dedup_and_an_empty_target(spark, tmp_path):
    log, target = str(tmp_path / "log"), str(tmp_path / "counts")
    append(spark, [flag(1, 1, 3), flag(1, 1, 3), flag(2, 1, 5)], log)
    assert S.read_flag_counts(spark, target).count() == 0
    S.compact_flag_counts(spark, target)
    S.run_flag_counts(spark, log, target, str(tmp_path / "check"), distinct=False)
    assert rows(S.read_flag_counts(spark, target)) == batch_answer(spark, log, distinct=False)


def test_extra_keys_never_touch_the_core(spark):
    extra = {k: "theirs" for k in [*W.CORE_FLAG_KEYS, "run"]}
    df = spark.createDataFrame([(*flag(1, 7, 3)[:5], extra, ["a", "b"])], f"{SCHEMA}, sub_query_keys array<string>")
    got = W.merge_extra(df).select("fields").first()[0]
    assert got["run"] == "theirs" and got["req_id"] == "7" and got["role"] == "r" and got["sub_query_keys"] == '["a","b"]'
    assert "theta" not in got and "chunker" not in got and len(W.CORE_FLAG_KEYS) == 10
    none = W.merge_extra(df.withColumn("extra", F.lit(None).cast("map<string,string>"))).select("fields").first()[0]
    assert sorted(none) == sorted(["flag_type", "timestamp", "candidate_id", "role", "req_id", "sub_query_keys"])
