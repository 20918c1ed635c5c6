"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from wattspark import build_session, registry

HEADLINE = (
    "agg01_ftp_by_period",
    "agg05_best_efforts",
    "agg14_fitness_by_month",
    "agg16_zone_distribution",
    "win05_rolling_quantiles",
    "win07_normalized_power",
    "win12_best_windows",
    "win02_leaderboard",
    "joi11_box_overlap",
    "joi12_similar_routes",
    "joi16_asof_ftp",
    "joi18_interpolated_ftp",
    "set01_feed",
    "set03_closure",
    "set10_merged_windows",
    "snk08_upsert",
    "krn09_critical_power",
    "fnm09_rolling_ftp",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
        print(name, took[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
