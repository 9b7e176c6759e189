"""Times the headline queries and prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Each query's result is fully
computed and thrown away; the first query warms the session up and is timed again like the others.
"""

from __future__ import annotations

import json
import os
import time

from rankwell.plans import QUERIES
from rankwell.session import build_session

HEADLINE = [
    "cosine_baseline_rank", "union_dedup_topk", "threshold_chunks", "rank_candidates", "composed_total", "block_rules",
    "rubric_req_score", "pool_comparison", "scorer_vs_judge", "score_variance", "rank_shift", "rank_correlation",
    "study_stability", "experience_months_merged", "parse_date_range", "sectionize", "chunk_by_entry",
    "chunk_paragraph_pack", "chunk_recursive", "section_evidence", "keyword_topk", "presence_match", "tier_lookup",
    "degree_match", "audit_schema", "audit_completeness", "audit_evidence", "allocate_ids", "flag_stream_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    run(names[0])
    times = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
