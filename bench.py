"""Times the headline queries and prints one line of JSON.

``BENCH_SF_DIR`` names the test data, ``BENCH_CPUS`` the number of local cores.
Every query is run in full into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "A1_overview",
    "A2_traffic_kpis",
    "A3_period_comparison",
    "A4_traffic_trend_daily",
    "A4_traffic_trend_daily_unique",
    "A5_dimension_ranking",
    "A7_tool_kpis",
    "A10_tool_scorecard",
    "A11_tool_extremes",
    "A15_usage_share",
    "A18_user_details",
    "A19_file_stats",
    "A28_run_summary",
    "J7_latest_tool",
    "J10_session_source",
    "J13_nested_files",
    "N1_returning_visits",
    "N2_upload_batches",
    "N3_rate_limit",
    "O7_list_files",
    "O7_list_jobs",
    "S2_visit_ingest",
    "M3_bulk_suspend",
    "W3_daily_limit",
    "W4_error_log",
    "W4_error_stream",
    "W5_activity_windows",
    "W6_job_states",
    "D2_merge",
    "D3_split",
    "D4_delete_pages",
    "D8_compare_documents",
    "D9_redaction_verdicts",
    "D9_redact",
    "D11_detect_marks",
    "D13_removal_counts",
    "L1_guess_language",
    "L3_document_language",
    "U1_batch_map",
)


def main() -> None:
    from foliometer.plans import load_queries
    from foliometer.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    queries = load_queries()
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    # The first jobs of a session pay for loading classes, Unicode tables and Python
    # workers; that is not a query's cost.
    for name in ("A8_tool_counts", "E25_compact", "U4_nfkc"):
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        started = time.perf_counter()
        result = queries[name].run(spark, folder)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    line = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
