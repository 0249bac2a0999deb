"""Times the headline queries; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quill.plans import registry

HEADLINES = [
    "series_day", "series_week", "event_enriched", "session_rollup", "daily_rollup", "overview_summary", "top_policies", "user_list_page", "user_top_events", "timeline_page",
    "queue_overview", "queue_ranked", "stale_jobs", "run_gaps", "failure_streaks", "new_and_repeated", "triage", "rotation_plan_3", "url_canonical", "identity_keys", "dup_groups",
    "policy_theme", "run_audit", "page_validity", "registry_match", "near_dup_pairs", "report_json", "report_violations", "evidence_coverage", "company_lookup",
]


def main() -> None:
    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES[HEADLINES[0]](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session
    took = {}
    for name in HEADLINES:
        every = []
        for _ in range(runs):
            t = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            every.append(time.perf_counter() - t)
        took[name] = round(statistics.median(every), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("/sf", 1)[-1]}))


if __name__ == "__main__":
    main()
