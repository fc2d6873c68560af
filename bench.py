"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from recfuse import build_session
from recfuse.registry.load import QUERIES

HEADLINE = [
    "fused_claims",
    "ranked_claims",
    "base_conflicts",
    "fusion_log",
    "conflicts_by_key",
    "conflict_summary",
    "valid_claims",
    "curation_statistics",
    "best_of_clusters",
    "similar_name_groups",
    "two_pass_parts",
    "upserted_orders",
    "launches_with_children",
    "launch_list_page",
    "launch_search",
    "system_statistics",
    "latency_percentiles",
    "news_page_records",
    "order_card_records",
    "order_table_records",
    "order_kit_records",
    "event_counters",
    "trailing_requests",
    "admitted_requests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", cpus, {"spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up, code generation and Python workers are not what is measured: a first pass on the
    # smallest tables warms them.
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in names if os.path.isdir(warm_dir) else []:
        QUERIES[name].run(spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    found = re.search(r"sf([0-9.]+)/?$", sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
                "cpus": cpus,
                "claim_rows": lines,
                "fused_rows_per_sec": round(lines / times["fused_claims"]) if "fused_claims" in times else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
