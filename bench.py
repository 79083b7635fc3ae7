"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR picks the data (default /root/testdata/sf0.1), BENCH_CPUS the
threads (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillweave.catalog import QUERIES
from tillweave.session import SESSION_SETTINGS

DATA_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = [
    "scan_parquet",
    "join_inner",
    "agg_mean_count",
    "agg_quantile",
    "pivot_fill",
    "unpivot_columns",
    "raw_sales_long",
    "raw_price_daily",
    "prodloc_lifecycle",
    "trim_leading_zeros",
    "out_of_stock",
    "oos_report",
    "wide_to_oos_report",
    "hierarchy_panel",
    "assortment_size_store",
    "calendar_fourier",
    "event_lead_lag",
    "event_window_gmm",
    "regressor_table",
    "design_matrix",
    "store_panel",
    "category_state_panel",
    "rolling_splits",
    "sample_weights",
    "lasso_by_group",
    "backtest_metrics",
    "binned_entropy",
    "approximate_entropy",
    "spectral_ar_entropy",
    "trend_season_strength",
]


def main() -> None:
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tillweave-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        # Every row and column is computed; nothing is kept.
        QUERIES[name](spark, DATA_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("agg_global")  # starts the JVM's code paths; not counted
    chosen = sys.argv[1:] or HEADLINES
    seconds = {name: round(run(name), 3) for name in chosen}
    scale = re.search(r"sf([0-9.]+)", DATA_DIR)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
