"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder with the tables (default /root/testdata/sf0.1).
BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from prodseries.plans.registry import QUERIES

HEADLINE = (
    "daily_fact", "vw_daily", "vw_monthly", "vw_lifetime", "vw_field_monthly", "vw_downtime_episodes", "vw_dq_review",
    "a1_oil_rank", "a5_peak_checkpoints", "a9_yearly_share", "a11_transitions", "a12_entry_effect",
    "load_core_violations", "qc_results", "reconcile_detail", "reconcile_summary", "nq_record_state", "nq_state_summary",
    "pf_numeric", "pf_missingness", "nq_coverage", "nq_missing_pattern", "nq_abrupt_changes", "nq_floor_sensitivity",
    "dash_wells", "dash_field_kpis", "dash_well_summary", "dash_active_by_type", "dash_ranking", "dash_profiles_smoothed",
    "gt_answers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the noop sink runs the whole plan without moving rows to the driver
    QUERIES["vw_downtime_episodes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
