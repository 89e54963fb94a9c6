"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs once
cold (including the stages it rests on, when it is the first to need them) and
three times warm; the reported figure is the warm median. Results are written to
the ``noop`` sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import bindings as b  # noqa: E402
from checks.catalog import ENTRIES  # noqa: E402
from ledgerlens.operators import rfm  # noqa: E402
from ledgerlens.plans.segmentation import segment_customers  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402

HEADLINE = (
    "clean_transactions", "cleaning_audit", "detect_wholesale", "monthly_trend", "distribution_stats", "rfm_table",
    "rfm_score_quintile", "segment_profile", "purchase_interval_churn", "cohort_clv", "left_join_features_fill0",
    "btyd_summary", "bgnbd_expected_purchases", "clv_discounted", "star_merge_orders", "rfm_score_tertile",
    "top_schools_per_decade", "top_quintile_teams", "join_first_last_season", "pivot_share", "group_concat",
    "kth_neighbor_distance", "roc_auc", "youden_threshold", "stratified_split", "call_list",
    "profile_table", "box_stats", "davies_bouldin", "silhouette",
)
WARM_RUNS = 3


def _raw_to_segments(spark, sf):
    """The whole segmentation from raw lines, sharing no stored stage."""
    return rfm.segment_profile(segment_customers(b.transactions(spark, sf)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: ENTRIES[name].run for name in HEADLINE} | {"raw_to_segments": _raw_to_segments}
    cold, warm = {}, {}
    for name, run in runs.items():
        times = []
        for _ in range(1 + WARM_RUNS):
            start = time.perf_counter()
            run(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[name], warm[name] = round(times[0], 3), round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "sum of warm medians", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
