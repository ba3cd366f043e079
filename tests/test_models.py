from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mlwatch.operators import evaluate as E
from mlwatch.operators import profile as P
from mlwatch.operators import split as S
from mlwatch.operators import train as T


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(400, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["id"] = range(400)
    pdf["y"] = np.where(x[:, 0] + 0.3 * x[:, 1] > 0, "yes", "no")
    pdf["r"] = 3 * x[:, 0] - x[:, 1] + rng.normal(scale=0.1, size=400)
    return spark.createDataFrame(pdf)


def test_split_sizes_add_up_and_repeat(spark, points):
    a = S.split(points, ["id"], 0.2, 1, "y")
    counts = {(r.split, r.y): r["count"] for r in a.groupBy("split", "y").count().collect()}
    assert counts[("test", "yes")] + counts[("test", "no")] == 80
    share = {y: counts[("test", y)] / (counts[("test", y)] + counts[("train", y)]) for y in ("yes", "no")}
    assert all(abs(s - 0.2) < 0.01 for s in share.values())
    b = S.split(points.repartition(5), ["id"], 0.2, 1, "y")
    assert a.select("id", "split").exceptAll(b.select("id", "split")).count() == 0
    c = S.split(points, ["id"], 0.2, 2, "y")
    assert a.where("split='test'").join(c.where("split='test'"), "id").count() < 80


def test_split_bounds_and_continuous_target(spark, points):
    with pytest.raises(ValueError, match="test_size"):
        S.split(points, ["id"], 0.6)
    with pytest.raises(ValueError, match="400 classes"):
        S.split(points, ["id"], 0.25, stratify="r")
    assert S.split(points, ["id"], 0.25).where("split = 'test'").count() == 100
    classes = spark.range(105).selectExpr("id", "IF(id < 100, id % 20, NULL) AS y")
    assert S.split(classes, ["id"], 0.2, stratify="y").where("split = 'test'").count() == 21


def test_tiny_class_may_have_no_test_rows(spark):
    df = spark.range(101).select("id", F.when(F.col("id") == 0, "rare").otherwise("big").alias("y"))
    out = S.split(df, ["id"], 0.2, stratify="y")
    assert out.where("split = 'test'").count() == 21


def test_folds_are_even(spark, points):
    out = S.kfold(points, ["id"], 7, 3, "y")
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert sorted(sizes) == [57] * 6 + [58]
    per = out.groupBy("fold", "y").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r.d <= 1 for r in per.collect())


def test_standardize_uses_training_rows_and_spares_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "train"), (9.0, 5.0, "test")], "x double, k double, s string")
    z = S.standardize(df, ["x", "k"], fit_on=F.col("s") == "train")
    assert [(r.x, r.k) for r in z.collect()] == [(-1.0, 0.0), (1.0, 0.0), (7.0, 0.0)]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] * 2 + [("c", "a")], "y string, p string"
    )
    out = E.classification_metrics(df, "y", "p").first()
    assert out.accuracy == round(5 / 9, 4)
    assert out.precision == round((3 / 6 * 4 + 2 / 3 * 4 + 0) / 9, 4)
    assert out.recall == round((3 / 4 * 4 + 2 / 4 * 4 + 0) / 9, 4)
    grid = {(r.label, r.pred): r.n for r in E.confusion(df, "y", "p").collect()}
    assert len(grid) == 9 and grid[("c", "c")] == 0 and grid[("b", "a")] == 2


def test_auc_ties_hot_score_and_one_class(spark):
    rng = np.random.default_rng(3)
    s = np.where(rng.random(2000) < 0.4, 0.5, rng.random(2000).round(3))
    y = (rng.random(2000) < 0.3 + 0.3 * s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    rank = pd.Series(s).rank()
    pos = y.sum()
    want = (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))
    assert E.roc_auc(df, "y", "s").first()[0] == pytest.approx(want)
    assert E.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None
    curve = E.roc_curve(df, "y", "s").orderBy("fpr", "tpr").toPandas()
    assert np.trapezoid(curve.tpr, curve.fpr) == pytest.approx(want, abs=1e-4)
    slim = E.roc_curve(df, "y", "s", drop_intermediate=True).orderBy("fpr", "tpr").toPandas()
    assert len(slim) < len(curve) and np.trapezoid(slim.tpr, slim.fpr) == pytest.approx(want, abs=1e-4)


def test_regression_metrics_edge(spark):
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, f double")
    assert E.regression_metrics(flat, "y", "f").first().asDict() == {"rmse": 0.0, "mae": 0.0, "r2": 1.0}
    off = spark.createDataFrame([(2.0, 3.0), (2.0, 3.0)], "y double, f double")
    assert E.regression_metrics(off, "y", "f").first().r2 == 0.0


def test_profile_matches_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.exponential(size=200), "k": 1.0, "m": [np.nan] * 198 + [1.0, 2.0]})
    out = {r.feature: r for r in P.profile(spark.createDataFrame(pdf)).collect()}
    d = pdf.x.describe()
    r = out["x"]
    for got, want in ((r.mean, d["mean"]), (r.std, d["std"]), (r.p25, d["25%"]), (r.p75, d["75%"]),
                      (r.skewness, pdf.x.skew()), (r.kurtosis, pdf.x.kurt())):
        assert got == pytest.approx(want, abs=6e-5)
    assert (out["k"].skewness, out["k"].kurtosis) == (0.0, 0.0)
    assert (out["m"].missing, out["m"].missing_pct, out["m"].skewness) == (198, 99.0, None)


def test_kpis_of_no_runs(spark):
    none = spark.createDataFrame([], "metrics string, duration_seconds double, status string")
    k = P.experiment_kpis(none).first()
    assert (k.runs, k.best_accuracy, k.success_pct, k.platform_score) == (0, 0.0, 100.0, 50)


@pytest.mark.parametrize("algo", ["Logistic Regression", "Decision Tree", "SVM"])
def test_classifiers_learn(spark, points, algo):
    parts = S.split(points, ["id"], 0.25, 1, "y")
    m = T.fit(parts.where("split='train'"), ["a", "b", "c"], "y", algo, params={"max_iter": 10} if algo != "Decision Tree" else None)
    got = T.evaluate(parts.where("split='test'"), m)
    assert got["accuracy"] > 0.85
    assert T.importances(m, 1)[0][0] == "a"
    scored = T.score(parts, m, keep=["id"], meta={"model_id": "M1", "stage": "production"})
    assert scored.count() == 400 and scored.first().model_id == "M1"


def test_regression_run_leaves_registry_rows(spark, points):
    parts = S.split(points, ["id"], 0.25, 1)
    run = T.train_run("RUN001", "toy", parts, ["id"], ["a", "b"], "r", "Ridge Regression", "regression", 2)
    assert run.metrics["r2"] > 0.95 and len(run.cv["scores"]) == 2
    exp, model = T.run_to_rows(spark, run)
    assert exp.first().status == "completed" and len(exp.first().stages) == 3
    assert model.first().model_id == "RUN001"


def test_unsupported_algorithm(spark, points):
    with pytest.raises(ValueError, match="algorithm is called"):
        T.fit(points, ["a"], "r", "SVM", "regression")


def test_missing_feature_is_named(spark, points):
    m = T.fit(points, ["a", "b"], "y", "Decision Tree", params={"max_depth": 2})
    with pytest.raises(ValueError, match="are absent: b"):
        T.score(points.drop("b"), m)


def test_payload_shapes(spark):
    bodies = ['{"x": 1, "y": 2}', '[{"x": 3, "y": "7"}, {"y": 4, "x": 5, "z": []}]', "[6, 7]", "[[8, 9], [10, 11]]", " " * 99 + "[12,13]",
              '"nope"', "{broken", '{"x": 1}', "[1]", "[1,2,3]", '[1,"x"]', '{"x":"a","y":2}', "[]", "[[1,2],[3]]", '[[1,2],{"x":1}]', None,
              '[{"x":1,"y":2},5]', "[1, null]", "7"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    good, bad = T.explode_payload(df, "body", ["x", "y"], keep=["id"])
    rows = sorted((r.id, r.row_index, r.x, r.y) for r in good.collect())
    assert rows == [(0, 0, 1.0, 2.0), (1, 0, 3.0, 7.0), (1, 1, 5.0, 4.0), (2, 0, 6.0, 7.0), (3, 0, 8.0, 9.0), (3, 1, 10.0, 11.0), (4, 0, 12.0, 13.0)]
    assert sorted(r.id for r in bad.collect()) == list(range(5, len(bodies)))
    reasons = {r.id: r.reason for r in bad.collect()}
    assert reasons[6] == "not JSON" and reasons[7] == "missing feature" and reasons[8] == "vector length"
    assert reasons[10] == "not a number" and reasons[12] == "no rows"


def test_limits_are_errors(spark, points):
    with pytest.raises(ValueError, match="max_depth"):
        T.fit(points, ["a"], "y", "Decision Tree", params={"max_depth": 99})
    with pytest.raises(ValueError, match="no parameters.*min_samples_split"):
        T.fit(points, ["a"], "y", "Decision Tree", params={"min_samples_split": 2})
    with pytest.raises(ValueError, match="missing cells"):
        T.fit(points.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), ["a"], "y", "Decision Tree")
    wide = spark.range(50).selectExpr("id AS y", "id AS p")
    with pytest.raises(ValueError, match="50 classes"):
        E.confusion(wide, "y", "p", max_classes=10)


def test_stored_model(spark, points, tmp_path):
    m = T.fit(points, ["a", "b"], "y", "Logistic Regression", params={"max_iter": 5})
    again = T.load_model(T.save_model(m, str(tmp_path / "m")))
    one, two = (T.score(points, x, ["id"]).orderBy("id").collect() for x in (m, again))
    assert one == two and again.features == ["a", "b"] and again.classes == m.classes
    none = spark.createDataFrame([], "model_id string, dataset string, version int, stage string, created_at timestamp, artifact_path string")
    with pytest.raises(ValueError, match="no production model"):
        T.score_production(points, none, "d")
