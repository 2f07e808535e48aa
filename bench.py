"""Time the headline queries: median of three runs after one warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "tpch_q1 tpch_q3 tpch_q5 tpch_q6 tpch_q9 tpch_q13 tpch_q18 cb_q1 cb_q2 cb_q5 cb_q10 cb_q15 cb_q20 cb_q30 cb_q35 "
    "ds_window_cte scd2_history as_of_join period_lookup interval_join_left file_batches burst_match latency_rollup "
    "leaderboard session_window theta_join_band null_profile upsert_latest notification_filter zip_table_load "
    "knn_l2 knn_cosine bm25_topk"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE

    from lakeloom.plans import QUERIES
    from lakeloom.session import build_session

    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_median",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
