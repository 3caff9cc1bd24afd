"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   directory of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session (default: all)

Every query runs twice and its whole result is written to the no-op sink. `queries` holds the second time, `cold` the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_agg_top_slow", "q_join_regression", "q_agg_hourly_trend", "q_join_latest_correlated", "q_win_topk_per_key",
    "q_win_counter_delta", "q_win_rolling_stats", "q_win_idle_timeout", "q_agg_workload_profile", "q_agg_partial_final",
    "q_metric_correlation", "q_capacity_forecast", "q_agg_cost_daily", "q_agg_cost_rollup", "q_threshold_eval",
    "q_alert_rules_sql", "q_alert_dedup", "q_health_metrics", "q_idx_duplicate", "q_join_anti_unindexed",
    "q_vac_candidates", "q_agg_catalog_inventory", "q_sync_completeness", "q_sync_integrity", "q_set_reconcile_rows",
    "q_win_scd2_build", "q_win_scd2_validate", "q_join_asof_scd2", "q_unified_view", "q_br_ttl_expired",
    "q_schema_diff", "q_mask_compliance", "q_pii_text_scan", "q_as_overall", "q_as_phases", "q_as_cost_savings",
    "q_st_tumbling", "q_st_scd2",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from opslens.plans import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 3)

    cold = {name: run(name) for name in HEADLINE}
    warm = {name: run(name) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
                "cold": cold, "cold_total": round(sum(cold.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
