"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (default 2) to a no-op sink, so every row and column is
computed; the best time counts. Times include building the plan.
"""

import json
import os
import sys
import time

HEADLINE = [
    "bench_q1", "bench_q2", "bench_q3", "bench_q4", "bench_q5", "bench_q6",
    "site_overview", "live_snapshot", "activity_feed", "site_revenue_rank", "revenue_by_plan_ranges", "churn_risk",
    "hourly_stats", "heatmap_grid", "detect_step", "capacity_episodes", "revenue_drop_history", "zero_visit_history",
    "validation_report", "constraint_audit", "member_day_spine", "event_envelope", "event_decode",
    "stream_occupancy", "stream_daily_revenue", "stream_capacity_events", "stream_capacity_fold", "stream_dedup",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE

    from sitemetrics.plans.all import QUERIES
    from sitemetrics.session import build_session
    spark = build_session("bench", cores)

    def once(name):
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin
    times = {}
    for name in names:
        once(name)
        times[name] = round(min(once(name) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
