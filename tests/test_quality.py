from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mlwatch.operators import quality as Q


def base(spark, n, seed=42):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"f1": rng.normal(size=n), "f2": rng.normal(size=n), "target": [0] * (n // 2) + [1] * (n - n // 2)})
    return spark.createDataFrame(pdf)


def verdict(df, **kw):
    return Q.validate(df, "target", **kw).first()


def test_missing_counts_nan_and_null(spark, small):
    df = small.withColumn("f2", F.when(F.col("f1") < 3, F.lit(None).cast("double")).otherwise(F.col("f2")))
    rows = [(r["column"], r.missing_count, r.missing_pct) for r in Q.missing_report(df, ["f1", "f2", "f3"]).collect()]
    assert rows == [("f2", 2, 50.0), ("f3", 1, 25.0), ("f1", 0, 0.0)]
    assert Q.missing_total(df, ["f1", "f2", "f3"]).first().asDict() == {"total_missing": 3, "total_missing_pct": 25.0}


def test_missing_of_empty_frame_is_zero(spark, small):
    out = Q.missing_report(small.where("f1 < 0"), ["f1"]).first()
    assert (out.missing_count, out.missing_pct) == (0, 0.0)


@pytest.mark.parametrize("two_step", [False, True])
def test_duplicates_count_all_copies_and_treat_missing_as_equal(spark, two_step):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1.0, "a"), (1.0, "a"), (nan, "b"), (None, "b"), (2.0, None), (None, "2.0"), (-0.0, "z"), (0.0, "z")],
        "x double, y string",
    )
    out = Q.duplicate_report(df, two_step=two_step).first()
    assert out.duplicate_rows == 6
    assert out.duplicate_rows_pct == pytest.approx(75.0)


def test_constant_needs_two_values_and_ignores_float_noise(spark, small):
    assert [r.feature for r in Q.constant_report(small, ["f1", "f2", "f3"]).collect()] == ["f2"]
    assert Q.constant_report(small.limit(1), ["f1", "f2"]).count() == 0
    tenth = spark.range(1000).select(F.lit(0.1).alias("x"))
    assert Q.constant_report(tenth).count() == 1


def test_constant_of_text_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", None, None)], "p string, q string, r string")
    assert {r.feature for r in Q.constant_report(df).collect()} == {"p", "q"}


def test_outliers_against_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500), [50.0, -50.0, np.nan]])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "c": 1.0}))
    s = pd.Series(x).dropna()
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    iqr = int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())
    z = int((((s - s.mean()) / s.std()).abs() > 3).sum())
    got = {r.feature: r for r in Q.outlier_report(df).collect()}
    assert got["x"].outlier_count == iqr and got["x"].outlier_pct == pytest.approx(iqr / len(x) * 100)
    got = {r.feature: r.outlier_count for r in Q.outlier_report(df, method="zscore").collect()}
    assert got == {"x": z, "c": 0}
    lo, hi = s.quantile(0.001), s.quantile(0.999)
    got = {r.feature: r.invalid_count for r in Q.range_report(df).collect()}
    assert got == {"x": int(((s < lo) | (s > hi)).sum()), "c": 0}


def test_class_summary(spark, small):
    out = Q.class_summary(small, "target").first()
    assert out.imbalance_ratio == 3.0
    assert out.entropy == pytest.approx(0.811278, abs=1e-6)
    one = Q.class_summary(small.where("target = 0"), "target").first()
    assert one.imbalance_ratio is None and one.entropy == 0.0


def test_correlation_skips_constants_and_pairs_complete_rows(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, np.nan], "b": [2.0, 4, 6, 8.1, 1], "c": [1.0, 1, 1, 1, 1], "d": [5.0, 1, 4, 2, 3]})
    got = {(r.feature_a, r.feature_b): r.abs_corr for r in Q.correlations(spark.createDataFrame(pdf)).collect()}
    want = pdf.corr().abs()
    assert got[("a", "c")] is None
    for a, b in (("a", "b"), ("a", "d"), ("b", "d")):
        assert got[(a, b)] == pytest.approx(want.loc[a, b])
    pairs = Q.high_corr_pairs(spark.createDataFrame(pdf))
    assert Q.high_corr_features(pairs).first()[0] == ["a", "b"]


def test_empty_frame(spark, small):
    out = verdict(small.where("f1 < 0"))
    assert (out.quality_score, out.status, out.fail_reasons) == (0.0, "fail", ["empty_frame"])


def test_missing_target(spark, small):
    out = Q.validate(small, "label").first()
    assert (out.quality_score, out.fail_reasons) == (0.0, ["missing_target_column"])


def test_missing_and_duplicates_are_reasons(spark):
    df = base(spark, 40)
    df = df.unionByName(df.limit(3)).withColumn("f2", F.when(F.col("f1") > 0, F.col("f2")))
    reasons = verdict(df, thresholds={"missing_total_pct": 1.0}).fail_reasons
    assert "missing_values_too_high" in reasons and "duplicates_too_high" in reasons


def test_constant_text_imbalance_correlation(spark):
    df = base(spark, 60)
    assert "constant_features_detected" in verdict(df.withColumn("f1", F.lit(1.0))).fail_reasons
    assert "dtype_mismatch_suspected" in verdict(df.withColumn("f2", F.col("f2").cast("string"))).fail_reasons
    skew = spark.range(100).select(F.randn(1).alias("f1"), F.when(F.col("id") < 95, 0).otherwise(1).alias("target"))
    out = verdict(skew)
    assert out.imbalance_ratio == 19.0 and "class_imbalance_too_high" in out.fail_reasons
    twin = df.withColumn("f2", F.col("f1") * 2)
    out = verdict(twin)
    assert out.high_corr_pairs == 1
    assert any("multicollinearity" in a for a in out.recommendations)


def test_regression_task_ignores_classes(spark):
    out = verdict(base(spark, 60), task="regression")
    assert out.imbalance_ratio is None


def test_score_formula(spark):
    row = spark.createDataFrame(
        [(10.0, 5.0, 100, 5, 5, 5, 50, 5.5)],
        "missing_total_pct double, duplicates_pct double, outliers_total long, object_columns long, "
        "invalid_range_features long, constant_features long, high_corr_pairs long, imbalance_ratio double",
    )
    assert Q.quality_score(row).first().quality_score == pytest.approx(50.0)


def test_gate(spark, small):
    bad = Q.validate(small.where("f1 < 0"), "target")
    with pytest.raises(Q.BelowQuality) as e:
        Q.require_quality(bad, "toy")
    assert e.value.quality_score == 0.0 and e.value.fail_reasons == ["empty_frame"]


def test_groups_match_separate_runs(spark):
    df = base(spark, 80).withColumn("g", F.when(F.col("f1") > 0, "p"))
    by = {r.g: r for r in Q.validate(df, "target", by=["g"]).collect()}
    for g in ("p", None):
        part = df.where(F.col("g").eqNullSafe(F.lit(g))).drop("g")
        one = verdict(part)
        assert by[g].quality_score == pytest.approx(one.quality_score)
        assert by[g].fail_reasons == one.fail_reasons


def test_schema_compare(spark):
    cur = spark.createDataFrame([("d", "a"), ("d", "c"), ("e", "x")], "dataset string, column string")
    base_ = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset string, column string")
    out = {r.dataset: r for r in Q.compare_schema(cur, base_).collect()}
    assert out["d"].new_columns == ["c"] and out["d"].missing_columns == ["b"] and out["d"].has_baseline
    assert out["e"].new_columns == ["x"] and not out["e"].has_baseline


def test_many_columns_are_paired_in_one_scan(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 60))
    x[:, 59] = -3 * x[:, 0] + 0.01 * x[:, 1]
    x[rng.random((200, 60)) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(60)])
    pdf["g"] = np.arange(200) % 2
    df = spark.createDataFrame(pdf)
    out = Q.correlations(df, by=["g"])
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r.g, r.feature_a, r.feature_b): r.abs_corr for r in out.collect()}
    assert len(got) == 2 * 60 * 59 // 2
    for g in (0, 1):
        want = pdf[pdf.g == g].drop(columns="g").corr().abs()
        assert all(abs(got[g, a, b] - want.loc[a, b]) < 1e-9 for a, b in [("c0", "c59"), ("c3", "c7"), ("c10", "c11")])
