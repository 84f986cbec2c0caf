"""Headline queries, warm, median of three; one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orderlens import catalog  # noqa: E402
from orderlens.session import build_session  # noqa: E402

HEADLINE = [
    "a1_item_rollup", "a3_payment_rollup", "w2_latest_review", "j5_order_level", "p10_features",
    "a9_value_loyalty_grid", "a10_spend_tiers", "w3_spend_ranks", "a8_top_states",
    "a13_forecast_series", "a22_quality_profile", "a23_describe", "a16_dashboard_summary",
    "a19_risk_by_group", "k3_action_queue", "m7_best_threshold", "x1_tfidf_search",
    "x2_nearest_vectors", "x3_extractive_answers", "w4_direct_budget",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for attempt in range(runs + 1):  # the first run warms the JVM and is not counted
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of warm medians over the headline queries",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
