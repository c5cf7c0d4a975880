"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run whole into the noop sink: once to warm up, then the median of three runs.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paysleuth.catalog import QUERIES  # noqa: E402
from paysleuth.session import build_session  # noqa: E402

HEADLINE = [
    "user_history_7d",
    "fraud_volume_24h",
    "top_merchants_fraud",
    "merchant_daily_top50",
    "fraud_volume_hourly",
    "merchant_amount_daily",
    "latency_percentiles",
    "featurize",
    "featurize_ties",
    "user_profile",
    "detect_high_frequency",
    "detect_any",
    "encoder_set",
    "correlation_matrix",
    "temporal_split",
    "roc_auc",
    "pr_auc",
    "threshold_metrics",
    "data_drift",
    "drift_policy",
    "fraud_rate_alerts",
    "stream_features",
    "stream_hourly",
]
# heavy single runs: no repetition
ONCE = {"stream_features", "stream_hourly"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "paysleuth-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(1 if name in ONCE else 3)), 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                "rows_per_sec": {n: int(rows / times[n]) for n in ("featurize", "stream_features")},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
