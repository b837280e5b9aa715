"""Time the headline queries: median of ``BENCH_RUNS`` (default 3) runs after one warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "P1_todays_articles", "J1_filter_new", "X5_extract_body", "X8_chunk_text", "S1_rss_items",
    "S7_html_links", "S9_listing_posts", "S13_toot_links", "S20_cap_per_source",
    "W1_upsert_visited", "W6_upsert_failures", "W7_merge_feedback", "R1_quota_select",
    "R5_number_articles", "A3_failure_stats", "J4_knn_cosine", "X12_final_score",
    "A7_update_nodes", "A8_update_edges", "J5_known_concepts", "J7_match_concepts",
    "J13_neighbors_of", "G1_connected_components", "G5_apply_feedback", "G6_bridge_edges",
    "D1_parse_briefing", "D4_render_briefing", "U1_score_relevance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("newsweft-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from newsweft.catalog import QUERIES

    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [q for q in HEADLINE if q in QUERIES]
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(taken), 4)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
