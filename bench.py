"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Step 1 (timed as ``ingest``) derives the detection tables from the driver parquet files and
stores them partitioned like production (annotations by dataset_id/source).  Every
headline query then runs from those stored tables to completion (``noop`` sink: the full
result is computed, nothing is collected).  ``value`` is the sum of the query times.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "E9_error_summary", "E9_error_labels", "E10_annotation_triage", "E11_worst_images",
    "E4_pr_curve", "E5_interpolated_ap", "E6_map_summary", "E7_confusion_matrix", "E12_greedy_match",
    "E13_per_class_metrics", "A1_class_distribution", "A4_facets", "A10_group_annotations",
    "F7_filter_samples", "T2_page", "M8_add_tag", "V1_find_similar", "V3_near_duplicate_groups",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from boxlens import get_spark
    from boxlens.fixtures import derived
    from boxlens.plans import catalog
    from boxlens.session import pin_scope
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=2 * cpus)
    work = os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="boxlens-bench-", dir="/tmp")
    times: dict[str, float] = {}
    t0 = time.time()
    derived(spark, sf_dir).materialize(f"{work}/tables")
    times["ingest"] = round(time.time() - t0, 3)
    for name in (only or HEADLINE):
        t0 = time.time()
        with pin_scope(spark):          # tables a query stores on the way are removed behind it
            df = catalog.QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
    total = round(sum(v for k, v in times.items() if k != "ingest"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir, "cpus": cpus}))


if __name__ == "__main__":
    main()
