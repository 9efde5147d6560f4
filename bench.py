"""Benchmark the headline queries.

Runs each query on the tables in $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] (default 8): one warm-up, then the median of
$BENCH_REPS timed runs (default 3), each written to the ``noop`` sink so the
whole plan executes. Session start-up is excluded. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["c360_master", "cohort_retention_long", "km_by_tier", "revenue_forecast_12m",
            "correlation_matrix", "cox_hazard_ratios", "churn_cv_auc"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from retentia.plans.registry import QUERIES
    from retentia.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="retentia-bench")
    times: dict[str, float] = {}
    for name in only:
        fn = QUERIES[name]

        def run() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()  # warm-up
        times[name] = round(statistics.median(run() for _ in range(reps)), 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total_sec", "value": total, "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus, "reps": reps, "spark": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
