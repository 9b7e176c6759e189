"""The composed run: target years by hand, and runs that are stopped and started again."""

import os
import uuid
from dataclasses import replace

import pytest

from rankwell.operators import composed as C
from rankwell.plans.catalog import Tables
from rankwell.plans.scoring import composed_inputs
from rankwell.runtime import scratch_path


def test_target_years_by_hand(spark):
    reqs = spark.createDataFrame(
        [("r", 1, "5+ Years of Go", None), ("r", 2, "Go", 4.0), ("r", 3, "3 years Go", 0.0), ("r", 4, "Go", None), ("r", 5, "2 years Go", None), ("q", 5, "Go", 0.0)],
        "role string, req_id int, req_name string, expected_years double",
    )
    asked = spark.createDataFrame(
        [("r", 2, 1, "How many years, about 7 years?"), ("r", 5, 2, "Years of use, 9 years?"), ("r", 5, 1, "How many years, 8+ years?"), ("r", 5, 0, "Depth, 6?"), ("r", 4, 1, "How many years?")],
        "role string, req_id int, sq_pos int, sq_text string",
    )
    got = {(r.role, r.req_id): r.target_years for r in C.target_years(reqs, asked).collect()}
    assert got == {("r", 1): 5.0, ("r", 2): 4.0, ("r", 3): 3.0, ("r", 4): None, ("r", 5): 8.0, ("q", 5): 0.0}


def files(folder):
    return {(os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, names in os.walk(folder) for f in names}


@pytest.mark.parametrize("stage", ["judge", "meet"])
def test_a_stopped_run_goes_on_and_scores_nobody_twice(spark, monkeypatch, stage):
    inputs = composed_inputs(Tables(spark, "/root/testdata/sf0.001"))
    few = inputs.candidates.where("role IN (0, 3)")
    inputs = replace(inputs, candidates=few, requirements=inputs.requirements.where("role IN (0, 3)"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(C.composed_requirements(spark, inputs, scratch_path(spark, "whole"), "a").select(*C.SCORE).withColumn("reason", C.F.coalesce("reason", C.F.lit(""))).withColumn("branch", C.F.coalesce("branch", C.F.lit(""))))
    folder, calls, plain = scratch_path(spark, f"run-{uuid.uuid4().hex}"), [], getattr(C, stage)

    def counted(given, candidates, *rest):
        calls.append(len(calls))
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return plain(given, candidates, *rest)

    monkeypatch.setattr(C, stage, counted)
    with pytest.raises(RuntimeError):
        C.composed_requirements(spark, inputs, folder, "b", parts=2)
    local = folder.removeprefix("file:")
    before = files(local)
    again = C.composed_requirements(spark, inputs, folder, "b", parts=2)
    assert before and before <= files(local) and len(calls) == 3
    filled = again.select(*C.SCORE).withColumn("reason", C.F.coalesce("reason", C.F.lit(""))).withColumn("branch", C.F.coalesce("branch", C.F.lit("")))
    assert rows(filled) == whole
    assert again.groupBy(*C.REQ).count().where("count > 1").count() == 0

    # A third start has nothing to do; candidates who come later are scored alone.
    C.composed_requirements(spark, inputs, folder, "b", parts=2)
    assert len(calls) == 3
    late = spark.createDataFrame([(0, 10**9, "Works in Lyon", 9.0)], few.schema)
    more = C.composed_requirements(spark, replace(inputs, candidates=few.unionByName(late)), folder, "b", parts=2)
    assert len(calls) == 4 and before <= files(local)
    assert {r.reason for r in more.where("candidate_id = 1000000000").collect()} == {None, "no_sub_queries", "no_evidence"}
    assert more.count() == again.count() + 6
