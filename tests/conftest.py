from __future__ import annotations

import math
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("mlwatch-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    if s.conf.get("spark.checkpoint.dir", None) is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mlwatch-test-"))
    yield s
    s.stop()


@pytest.fixture
def small(spark):
    """Four rows with an outlier, a constant, a missing value and an unbalanced target."""
    rows = [(1.0, 0.0, 5.0, 0), (2.0, 0.0, math.nan, 0), (3.0, 0.0, 7.0, 0), (100.0, 0.0, 8.0, 1)]
    return spark.createDataFrame(rows, "f1 double, f2 double, f3 double, target int")
