"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed runs per query
(their median counts; one untimed run comes first). Results are computed in full and thrown away
by the ``noop`` sink. The transfer table all queries start from is written before the clock
starts; ``prepare`` says how long that took.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from transferwatch.queries import QUERIES  # noqa: E402
from transferwatch.session import prepare  # noqa: E402
from transferwatch.sources import fixtures  # noqa: E402

HEADLINES = [
    "high_risk_hours",
    "stratified_split",
    "amount_outliers",
    "sender_totals",
    "unique_counterparties",
    "freq_account_pair",
    "target_account",
    "rolling_mean",
    "rolling_std",
    "rolling_unique_receivers",
    "velocity_sender",
    "velocity_receiver",
    "request_metrics",
    "training_features",
    "lookup_export",
    "production_features",
    "production_features_frozen",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("transferwatch-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    start = time.perf_counter()
    run(fixtures.transactions(spark, sf_dir))
    prepared = time.perf_counter() - start

    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "prepare": round(prepared, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
