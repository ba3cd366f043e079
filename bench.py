"""Seconds per headline query, as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from mlwatch import plans

# Headline queries: each exercises one kind of plan.
HEADLINE = (
    "drift_features",
    "psi",
    "drift_by_day",
    "quality_score",
    "duplicate_report",
    "duplicate_documents",
    "outliers_iqr",
    "high_corr",
    "profile",
    "split",
    "kfold",
    "class_metrics_lineitem",
    "roc_auc",
    "regression_metrics",
    "register_versions",
    "recent_production",
    "apply_transitions",
    "upsert_latest",
    "audit_trail",
    "dataset_version",
    "histogram",
    "event_rate_sliding",
    "dedup_repeat",
    "log_rollup",
    "stream_rate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mlwatch-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="mlwatch-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
