"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full (no-op sink: every row computed, nothing
collected), warm, median of $BENCH_REPS runs (default 3).  Prints ONE JSON
line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_sales", "kpis", "top_products", "trend_weekly_iso", "abc", "slow_movers", "anomalies",
    "product_list", "stock_status", "alerts_all", "clean_accept", "fact_build", "rolling_features",
    "metrics", "context_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE

    from tillcast.session import local_session
    from tillcast.plans.catalog import QUERIES

    spark = local_session(cpus, max(8, 2 * cpus), app="tillcast-bench")
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for i in range(reps + 1):          # first run warms caches / codegen
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0 or reps == 0:
                runs.append(dt)
        times[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
