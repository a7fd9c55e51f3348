"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans.catalog import raw_queries
from tidemark.session import build_session

HEADLINE = [
    "period_rollup", "gap_fill_auto", "winsorize", "history_summary", "rolling_features", "direct_frame",
    "demand_class", "lifecycle", "backtest_exact", "leaderboard", "series_weights", "part_forecast",
    "portfolio_forecast", "hierarchy_rollup", "mrp", "capacity_plan", "actions", "fva", "drift", "plan_audit", "ets",
    "ridge", "stream_rollup_daily",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = raw_queries()
    # one small query first, so that no headline pays for starting the JVM
    queries["length_gate"](spark, folder).collect()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
