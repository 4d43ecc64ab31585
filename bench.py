"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (warm runs per query, median reported; default 3).

The test tables are single files of one row group, which one task scans. Before the timed runs, and
outside them, each is dealt once into as many files as there are cores, as a large table would be.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from uas_spark.plans.registry import QUERIES  # noqa: E402
from uas_spark.session import build_session  # noqa: E402

HEADLINE = ["join_zone_asof", "join_positions_registration", "join_positions_covering_auth",
            "join_boxes_flight_plans", "join_positions_zone_current", "join_positions_forecast_zone",
            "zone_latest_fresh", "zone_forecast_nearest", "dedup_append_live", "registration_overlap",
            "authorization_lifecycle", "sun_times", "sensor_coverage", "zone_observed_at_point"]


def _run(df) -> None:
    # full evaluation of every row and column without collecting to the driver
    df.write.format("noop").mode("overwrite").save()


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _dealt(spark, sf_dir: str, files: int) -> str:
    """The tables of ``sf_dir``, each in ``files`` files, in a scratch folder (the bench is local)."""
    home = tempfile.mkdtemp(prefix="uas-bench-")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{home}/{name}.parquet")
    return home


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", max(cpus * 2, 8), app="uas_spark_bench",
                          extra={"spark.driver.memory": "16g"})
    times, sf = {}, os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    sf_dir = _dealt(spark, sf_dir, cpus)
    for key in HEADLINE:
        if key not in QUERIES:
            continue
        fn = QUERIES[key]
        _run(fn(spark, sf_dir))  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            _run(fn(spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(samples), 3)
    print(json.dumps({"metric": "median_warm_query_seconds_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
