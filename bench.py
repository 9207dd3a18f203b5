"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores;
``BENCH_ONLY`` is a comma-separated list of name prefixes, ``BENCH_REPEAT`` the number of timed runs (the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from pyspark.sql import SparkSession

from catalog import QUERIES

HEADLINE = [
    "flagship",
    "s_02_read_long",
    "v_07_duplicates",
    "i_01_infer_resolution",
    "e_05_to_grid",
    "e_07_remove_outliers",
    "e_13_impute_linear",
    "e_16_impute_pchip",
    "e_17_impute_historical",
    "e_18_null_short_islands",
    "e_19_impute_recent",
    "e_22_resample_averaging",
    "f_06_time_covariates",
    "j_08_shift_ranges",
    "p_02_split_fragments",
    "m_01_lag_features",
    "m_03_seasonal_naive",
    "m_04_random_forest",
    "m_06_differenced_ar",
    "b_09_metrics_by_series",
    "r_03_score_trials",
    "x_01_window_dataset",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in (QUERIES if only else HEADLINE) if not only or any(n.startswith(p) for p in only)]
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()  # start the engine
    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            t = time.time() - t
            best = t if best is None else min(best, t)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
