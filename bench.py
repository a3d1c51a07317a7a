"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from aisle.plans import all_queries
from aisle.session import build_session

HEADLINE = [
    "kpi04_growth_vs_last_year", "kpi01_master_dataset", "kpi10_period_report", "kpi08_rfm_features", "agg01_group_sums",
    "agg02_distinct_counts", "agg09_pivot_sum", "agg16_exact_percentiles", "jn03_enrich_features", "jn14_orders_traffic_tree",
    "win03_lag_ladder", "win04_rolling_range", "win07_trailing_stats", "win11_diversity", "win15_abc_class",
    "win24_promo_runs", "dq03_contract", "dq12_fact_consistency", "evl03_method_table", "evl09_areas",
    "ts01_densify", "ts03_weekly_mart", "ts08_baseline_clean", "ts10_trendline", "ts17_secondary_to_primary",
    "prm01_promo_weeks", "prm13_overlaps", "prm14_phasing_curve", "str02_clean_title", "str06_fuzzy_brand",
    "str17_bag_of_words", "mlj12_knn_classify", "mlj19_leave_one_out",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
    })
    queries = all_queries()
    queries["srt01_global_sort"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
