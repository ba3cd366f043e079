"""Registered queries against their SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return v.isoformat() if isinstance(v, pd.Timestamp) else repr(v.item() if hasattr(v, "item") else v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# A few of each module; all of them are compared at a larger scale outside the unit tests.
NAMED = (
    "drift_features drift_by_day missing_report duplicate_documents outliers_iqr high_corr validate profile split kfold "
    "class_metrics roc_auc_documents roc_curve register_versions latest_production apply_transitions rollback_hint "
    "upsert_latest dataset_version request_pages bucket_p95 event_rate_sliding inhibit dedup_repeat log_trace "
    "stream_rate stream_gauge stream_quality"
).split()


@pytest.mark.parametrize("name", NAMED)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
