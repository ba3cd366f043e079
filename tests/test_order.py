from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.operators import order
from mlwatch.operators.narrowing import bucket_of
from mlwatch.operators.order import equi_depth, exact_quantiles, sliced_scan

PROBS = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]


def check(spark, values):
    pdf = pd.DataFrame({"x": values})
    row = exact_quantiles(spark.createDataFrame(pdf), ["x"], PROBS, accuracy=100).first()
    clean = pdf.x.dropna()
    assert row.c0_n == len(clean)
    np.testing.assert_allclose(row.c0_q, [clean.quantile(p) for p in PROBS], rtol=1e-12, atol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False) | st.sampled_from([0.0, 1.0, float("nan")]), min_size=1, max_size=60))
def test_quantiles_of_small_lists(spark, values):
    if np.isnan(values).all():
        values = [*values, 3.0]
    check(spark, [float(v) for v in values])


def test_comparisons_with_cut_points_are_compiled(spark, monkeypatch, capsys):
    frames, plain = [], order.settled
    monkeypatch.setattr(order, "settled", lambda df: (frames.append(df), plain(df))[1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the code is made step by step
    try:
        df = spark.range(1000).select(*[(F.col("id") * k % 97).cast("double").alias(f"x{k}") for k in (1, 2, 3, 5)])
        exact_quantiles(df, df.columns, [0.001, 0.25, 0.75, 0.999])
        frames[1].explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the virtual machine interprets longer methods


def test_quantiles_with_a_coarse_sketch_and_many_ties(spark):
    rng = np.random.default_rng(0)
    check(spark, np.concatenate([rng.normal(size=20_000), np.zeros(15_000), [np.nan] * 10]))


def test_quantiles_per_group_with_null_group_and_empty_column(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"),
        F.lit(None).cast("double").alias("y"),
    )
    pdf = df.toPandas()
    for r in exact_quantiles(df, ["x", "y"], [0.1, 0.75], by=["g"]).collect():
        want = pdf[pdf.g.isna() if r.g is None else pdf.g == r.g].x
        np.testing.assert_allclose(r.c0_q, [want.quantile(0.1), want.quantile(0.75)])
        assert r.c1_n == 0 and r.c1_q == [None, None]


@pytest.mark.parametrize("accuracy", [1, 3, 100])
def test_quantiles_with_most_values_in_one_interval(spark, accuracy, monkeypatch):
    """Intervals with more values than a task may sort are cut until they have fewer, whatever the values look like."""
    rng = np.random.default_rng(2)
    near = 1 + rng.random(9000) * 1e-6
    values = np.concatenate([near, [-1e300, 1e300, 0.0, -5.0], 2.0 ** rng.integers(-400, 400, 900), [7.0] * 500])
    sorted_in_task = []
    looked_up = order.looked_up

    def watched(rows, table, keys):
        out = looked_up(rows, table, keys)
        if {"below", "lo"} <= set(table.columns) and "v" in rows.columns:
            sorted_in_task.append(out.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(order, "looked_up", watched)
    df = spark.createDataFrame([(float(v), "g") for v in values], "x double, g string").repartition(5)
    got = exact_quantiles(df, ["x"], PROBS, by=["g"], accuracy=accuracy, most=40).first()
    np.testing.assert_allclose(got.c0_q, [pd.Series(values).quantile(p) for p in PROBS], rtol=1e-12)
    assert (sorted_in_task[-1] or 0) <= 40
    if accuracy == 1:
        assert sorted_in_task[0] > 0.9 * len(near)


def test_quantiles_when_the_sketch_misses(spark, monkeypatch):
    """Ranks outside the values that were kept are looked for again, with wider pairs."""
    tried = []
    at_ranks = order._at_ranks

    def missing_once(near, *a):
        tried.append(1)
        return at_ranks(near.withColumn("v", F.lit(None).cast("double")) if len(tried) == 1 else near, *a)

    monkeypatch.setattr(order, "_at_ranks", missing_once)
    check(spark, list(np.arange(500.0)))
    assert len(tried) == 2


def test_infinite_values(spark):
    values = [-math.inf, -1e308, 1.0, 2.0, 3.0, 1e308, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, ["x"], [i / 6 for i in range(1, 6)], accuracy=1, most=1).first().c0_q == values[1:-1]


def test_bucket_is_the_number_of_smaller_cuts(spark):
    edges = sorted([0.0, 1.0, 1.0, 2.0, 5.0, 8.0, 9.0])
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 1, 1.5, 5, 8.5, 100)], "v double")
    df = df.withColumn("e", F.array(*[F.lit(e) for e in edges]))
    for r in df.withColumn("b", bucket_of("v", "e", 8)).collect():
        assert r.b == sum(e < r.v for e in edges)


@pytest.mark.parametrize(("depth", "seconds"), [(1, 400_000), (64, 400_000), (64, 1), (300, 3), (10**6, 50)])
def test_sliced_scan_equals_plain_windows(spark, depth, seconds):
    """Also with all rows in one second, where the second column of the order parts them."""
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("k"),
        (F.timestamp_seconds(F.floor(F.rand(3) * seconds))).alias("ts"),
        F.when(F.rand(4) > 0.7, F.col("id")).alias("v"),
    )
    df = df.withColumn("ts", F.when(F.col("id") % 50 > 0, F.col("ts"))).checkpoint()
    w = W.partitionBy("k").orderBy("ts", "id")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select(
        "id", F.last("v", True).over(before).alias("lv"), F.row_number().over(w).cast("bigint").alias("n"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"), F.lead("v").over(w).alias("f"),
    )
    got = sliced_scan(
        df, ["k"], ["ts", "id"], last={"lv": F.col("v")}, total={"s": F.col("v")}, following={"f": F.col("v")}, rank="n", depth=depth
    ).select("id", "lv", "n", "s", "f")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_pieces_are_even_and_keep_ties(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, "large").alias("k"), F.lit(0).alias("ts"), (F.col("id") % 3000).alias("x"), "id"
    )
    pieced = equi_depth(df, ["k"], ["ts", "x"], "piece", depth=2500).checkpoint()
    sizes = {tuple(r[:2]): r[2] for r in pieced.groupBy("k", "piece").count().collect()}
    assert max(sizes.values()) <= 5000 and sizes[None, 0] == 2000 and len(sizes) > 4
    assert pieced.groupBy("k", "ts", "x").agg(F.count_distinct("piece").alias("n")).where("n > 1").count() == 0
    w = W.partitionBy("k").orderBy("ts", "x")
    assert pieced.withColumn("before", F.lag("piece").over(w)).where("before > piece").count() == 0
    assert equi_depth(df, ["k"], ["ts", "x"], "piece", depth=20_000) is None
