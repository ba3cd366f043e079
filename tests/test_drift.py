from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mlwatch.functions.stats import ks_pvalue
from mlwatch.operators import drift as D
from mlwatch.operators import narrowing
from mlwatch.plans.drift import lineitem_sides


def np_psi(r, c, n=10):
    if len(r) < 2 or len(c) < 2:
        return 0.0
    n = max(2, min(n, min(len(r), len(c)) // 15))
    lo, hi = min(r.min(), c.min()), max(r.max(), c.max())
    if not hi > lo:
        return 0.0
    e = np.linspace(lo, hi, n + 1)
    a, b = np.histogram(r, e)[0], np.histogram(c, e)[0]
    p, q = (a + 1) / (a.sum() + n), (b + 1) / (b.sum() + n)
    return round(float(np.sum((q - p) * np.log(q / p))), 5)


def np_ks(r, c):
    v = np.concatenate([r, c])
    r, c = np.sort(r), np.sort(c)
    return np.abs(np.searchsorted(r, v, "right") / len(r) - np.searchsorted(c, v, "right") / len(c)).max()


def frames(spark, shift=0.0, n=500, m=200, k=3):
    rng = np.random.default_rng(5)
    cols = [f"f{i}" for i in range(k)]
    r = pd.DataFrame(rng.normal(size=(n, k)), columns=cols)
    c = pd.DataFrame(rng.normal(loc=shift, size=(m, k)), columns=cols)
    c.iloc[0, 0] = np.nan
    return r, c, spark.createDataFrame(r), spark.createDataFrame(c)


@pytest.mark.parametrize("shift", [0.0, 0.3, 4.0])
def test_report_against_numpy(spark, shift):
    r, c, rs, cs = frames(spark, shift)
    out = {x.feature: x for x in D.drift_features(rs, cs).collect()}
    psi = {x.feature: x.psi for x in D.psi(rs, cs, list(r.columns)).collect()}
    for f in r.columns:
        cc = c[f].dropna().values
        assert out[f].psi == pytest.approx(np_psi(r[f].values, cc), abs=1e-5) == psi[f]
        assert out[f].ks_statistic == pytest.approx(np_ks(r[f].values, cc), abs=1e-5)
        if shift == 4.0:
            assert out[f].drift_detected and out[f].severity == "significant"


def test_ties_heavy_hitter_and_partition_count(spark):
    rng = np.random.default_rng(2)
    r = np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 20, 3000).astype(float))
    c = np.where(rng.random(2000) < 0.3, 7.0, rng.normal(9, 4, 2000))
    for parts in (1, 7):
        rs = spark.createDataFrame(pd.DataFrame({"x": r})).repartition(parts)
        cs = spark.createDataFrame(pd.DataFrame({"x": c})).repartition(parts)
        row = D.drift_features(rs, cs).first()
        assert row.psi == pytest.approx(np_psi(r, c), abs=1e-5)
        assert row.ks_statistic == pytest.approx(np_ks(r, c), abs=1e-5)


def test_identical_constant_tiny_and_absent(spark):
    same = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("k"))
    out = {r.feature: r for r in D.drift_features(same, same).collect()}
    assert out["x"].psi == 0.0 and out["x"].ks_statistic == 0.0 and out["x"].p_value == 1.0
    assert out["k"].psi == 0.0 and not out["k"].drift_detected
    assert D.psi(same.limit(1), same, ["x"]).first().psi == 0.0
    none = D.drift_features(same.where("x < 0"), same, ["x"]).first()
    assert none.psi == 0.0 and none.ks_statistic is None and none.drift_detected is False


def test_only_common_columns(spark):
    a = spark.createDataFrame([(1.0, 2.0, 3.0)] * 5, "a double, b double, c double")
    b = spark.createDataFrame([(1.0, 2.0, "x")] * 5, "b double, a double, d string")
    assert D.drift_columns(a, b) == ["a", "b"]
    assert D.drift_summary(D.drift_features(a, b)).first().features_analyzed == 2


@pytest.mark.parametrize(("drifted", "psi", "want"), [(6, 0.01, "critical"), (1, 0.2, "warning"), (0, 0.01, "stable")])
def test_summary_severity(spark, drifted, psi, want):
    rows = [(f"f{i}", psi, i < drifted) for i in range(10)]
    feats = spark.createDataFrame(rows, "feature string, psi double, drift_detected boolean")
    s = D.drift_summary(feats)
    assert s.first().overall_severity == want
    assert s.first().overall_drift == (drifted > 2)


def test_empty_summary(spark):
    feats = spark.createDataFrame([], "feature string, psi double, drift_detected boolean")
    s = D.drift_summary(feats).first()
    assert (s.features_analyzed, s.drift_ratio, s.overall_severity, s.average_psi) == (0, 0.0, "stable", 0.0)


def test_pvalue_known_points(spark):
    df = spark.createDataFrame([(1.0,), (0.1,), (2.0,)], "lam double")
    p = ks_pvalue(F.col("lam") / F.sqrt(F.lit(50.0)), F.lit(100), F.lit(100))
    got = [r[0] for r in df.select(p).collect()]
    assert got[0] == pytest.approx(0.2700, abs=1e-4)
    assert got[1] == 1.0
    assert got[2] == pytest.approx(0.00067, abs=1e-5)


def test_many_groups_against_one_reference(spark):
    rng = np.random.default_rng(9)
    r = pd.DataFrame({"x": rng.normal(size=800).round(2), "y": rng.exponential(size=800)})
    c = pd.DataFrame({"x": rng.normal(0.2, 1, 900).round(2), "y": rng.exponential(2, 900), "g": rng.integers(0, 4, 900)})
    c.loc[c.g == 3, "x"] = 50.0
    out = D.drift_by_group(spark.createDataFrame(r), spark.createDataFrame(c), ["g"], ["x", "y"])
    rows = {(x.g, x.feature): x for x in out.collect()}
    assert len(rows) == 8
    for (g, f), x in rows.items():
        cc = c[c.g == g][f].values
        assert x.psi == pytest.approx(np_psi(r[f].values, cc), abs=1e-5), (g, f)
        assert x.ks_statistic == pytest.approx(np_ks(r[f].values, cc), abs=1e-5), (g, f)


def test_perturb(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert [r.x for r in D.perturb(df, ["x"], shift=2.0).collect()] == [3.0, 4.0]
    assert [r.x for r in D.perturb(df, ["x"], noise=0.5).collect()] != [1.0, 2.0]
    with pytest.raises(ValueError, match="mean_shift"):
        D.perturb(df, ["x"], shift=11)


def test_health_and_alerts(spark):
    s = spark.createDataFrame(
        [(0.1, True, "warning", 0.5, 2), (0.9, False, "stable", 0.1, 0)],
        "average_psi double, overall_drift boolean, overall_severity string, drift_ratio double, features_drifted long",
    )
    assert [(r.health_score, r.health_label) for r in D.drift_health(s).collect()] == [(80, "STABLE"), (0, "DRIFTED")]
    alerts = D.drift_alerts(s, "iris").collect()
    assert [a.message for a in alerts] == ["Data drift detected for dataset=iris; ratio=0.50"]


def plain_distance(a, b):
    """The largest difference of the shares of values at most x, over all x."""
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()


@pytest.mark.parametrize("shape", ["same", "shifted", "ties", "wide", "one", "inside"])
def test_largest_gap_by_bound_and_prune(spark, shape, monkeypatch):
    """Few values travel, also when the sides hardly differ and when one part holds nearly all values."""
    monkeypatch.setattr(narrowing, "BINS", 64)
    monkeypatch.setattr(narrowing, "TASK_VALUES", 200)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=6000), rng.normal(size=5000)
    if shape == "shifted":
        b = b + 0.3
    elif shape == "ties":
        a, b = np.round(a, 1), np.round(b + 0.05, 1)
    elif shape == "wide":
        a, b = np.append(a, [-1e300, np.inf]), np.append(np.append(b * 1.1, 2.0 ** rng.integers(-300, 300, 500)), -np.inf)
    elif shape == "one":
        a, b = np.full(50, 3.0), np.full(20, 3.0)
    elif shape == "inside":
        a, b = np.append(a * 1e-9, [1e9]), np.append(b * 1e-9 + 2e-10, [-1e9])
    rows = [("x", 0, float(v)) for v in a] + [("x", 1, float(v)) for v in b]
    cells = spark.createDataFrame(rows, "feature string, side int, value double").repartition(4)
    both = np.concatenate([a, b])
    ranges = spark.createDataFrame([("x", len(a), len(b), float(both.min()), float(both.max()))], "feature string, n_ref long, n_cur long, lo double, hi double")
    d, _, travel = narrowing.largest_gap(cells, ranges, ["feature"])
    assert d.collect() == [("x", plain_distance(a, b))]
    assert travel.count() <= narrowing.SHARE * len(rows)
    assert (travel.groupBy("slot").count().agg(F.max("count")).first()[0] or 0) <= 200


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="tables not present")
def test_few_cells_travel(spark, monkeypatch):
    moved = []
    search = D.largest_gap

    def watched(cells, *a):
        out = search(cells, *a)
        moved.append((out[2].count(), cells.count()))
        return out

    monkeypatch.setattr(D, "largest_gap", watched)
    assert D.drift_features(*lineitem_sides(spark, "/root/testdata/sf0.1")).count() == 4
    assert moved[0][0] < 0.1 * moved[0][1]
