"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from waygrid.plans import catalog
from waygrid.session import build_session

HEADLINE = (
    "leave_one_out_topk", "threshold_sweep", "retrieval_metrics", "score_separation", "descriptor_match",
    "match_corridor", "snap_to_walkable", "fuse_positions", "detect_drift", "fit_quality", "live_log_summary",
    "nearest_keyframe", "turn_instructions", "colour_signature", "all_pairs_distance",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "16g",
        # the bench tables are single small files: read them by row group so all cores work
        "spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.openCostInBytes": "0",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the engine before timing
    times = {}
    for name in only:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
