from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mlwatch.operators import governance as G
from mlwatch.operators import lineage as L
from mlwatch.operators import predictions as H
from mlwatch.operators import registry as R
from mlwatch.sources import schemas

T0 = datetime(2024, 1, 1)


def fold(reqs):
    """The stage machine as a plain loop."""
    stage, holder, log = {}, {}, []
    for ds, m, to, at, i in sorted(reqs, key=lambda r: (r[3], r[4])):
        old = stage.get((ds, m), "development")
        if old == to:
            continue
        if to == "production":
            h = holder.get(ds)
            if h is not None and h != m:
                stage[(ds, h)] = "staging"
                log.append((ds, h, "production", "staging", i, 0))
            holder[ds] = m
        elif holder.get(ds) == m:
            holder[ds] = None
        stage[(ds, m)] = to
        log.append((ds, m, old, to, i, 1))
    return sorted(log), stage, holder


def random_requests(n=1500, seed=1):
    rnd = random.Random(seed)
    hot = ["d0"] * 5 + ["d1", "d2"]
    return [
        (rnd.choice(hot), f"m{rnd.randrange(6)}", rnd.choice(R.STAGES), T0 + timedelta(minutes=rnd.randrange(6000)), i)
        for i in range(n)
    ]


def test_stage_machine_equals_the_loop(spark):
    reqs = random_requests()
    df = spark.createDataFrame(reqs, "dataset string, model_id string, to_stage string, changed_at timestamp, event_id long")
    log = R.apply_transitions(df)
    got = sorted((r.dataset, r.model_id, r.from_stage, r.to_stage, r.event_id, r.ord) for r in log.collect())
    want, stage, holder = fold(reqs)
    assert got == want
    now = {(r.dataset, r.model_id): r.stage for r in R.current_stage(log).collect()}
    assert now == {k: stage[k] for k in now}
    hint = {r.dataset: r for r in R.rollback_hint(log).collect()}
    for ds, h in holder.items():
        assert hint[ds].current_production == h


def test_two_promotions_and_revert(spark):
    reqs = [("d", "M1", "production", T0, 1), ("d", "M2", "production", T0 + timedelta(days=2), 2)]
    df = spark.createDataFrame(reqs, "dataset string, model_id string, to_stage string, changed_at timestamp, event_id long")
    log = R.apply_transitions(df)
    rows = [(r.model_id, r.from_stage, r.to_stage, r.note) for r in log.orderBy("event_id", "ord").collect()]
    assert rows[1] == ("M1", "production", "staging", "auto-demoted while promoting M2")
    h = R.rollback_hint(log).first()
    assert (h.current_production, h.previous_production) == ("M2", "M1")
    assert R.revert(log, "d").first().model_id == "M1"
    with pytest.raises(ValueError, match="nothing held production"):
        R.revert(log.where("model_id = 'M2'"), "d")


def test_versions_and_parents(spark):
    none = spark.createDataFrame([], "model_id string, dataset string, version int, created_at timestamp, stage string")
    new = spark.createDataFrame(
        [("RUN001", "a", T0), ("RUN002", "a", T0 + timedelta(hours=30)), ("RUN003", "b", T0)],
        "model_id string, dataset string, created_at timestamp",
    )
    first = R.register(none, new)
    rows = {r.model_id: (r.version, r.parent_model_id) for r in first.collect()}
    assert rows == {"RUN001": (1, None), "RUN002": (2, "RUN001"), "RUN003": (1, None)}
    later = spark.createDataFrame([("RUN009", "a", T0)], "model_id string, dataset string, created_at timestamp")
    r = R.register(first, later).first()
    assert (r.version, r.parent_model_id, r.stage) == (3, "RUN002", "development")


def test_upsert_keeps_stage_and_takes_the_latest_change(spark):
    ddl = "model_id string, stage string, metrics string, created_at timestamp"
    cur = spark.createDataFrame([("M1", "production", "old", T0), ("M2", "staging", "old", T0)], ddl)
    new = spark.createDataFrame(
        [("M1", "development", "b", T0 + timedelta(days=2)), ("M1", "development", "a", T0 + timedelta(days=1)),
         ("M3", "development", "n", T0)], ddl)
    rows = {r.model_id: (r.stage, r.metrics) for r in R.save_models(cur, new).collect()}
    assert rows == {"M1": ("production", "b"), "M2": ("staging", "old"), "M3": ("development", "n")}
    rows = {r.model_id: (r.stage, r.metrics) for r in R.upsert(cur, new, ["model_id"], ["created_at"]).collect()}
    assert rows["M1"] == ("development", "b")


def test_insert_new_constraints_and_orphans(spark):
    cur = spark.createDataFrame([(1, "x")], "id int, v string")
    new = spark.createDataFrame([(1, "y"), (2, "a"), (2, "z"), (None, "n"), (None, "m")], "id int, v string")
    for parts in (1, 3, 5):
        got = R.insert_new(cur, new.repartition(parts), ["id"], ["v"]).collect()
        assert sorted(map(tuple, got), key=str) == [(1, "x"), (2, "z"), (None, "n")]
    new = spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "id int, v string")
    assert [tuple(r) for r in R.unique_violations(new, ["id"]).collect()] == [(2, 2)]
    child = spark.createDataFrame([(1,), (5,), (None,)], "fk int")
    assert [r.fk for r in R.orphans(child, cur, "fk", "id").collect()] == [5]


def test_filter_comes_before_limit_and_limits_are_checked(spark):
    df = spark.createDataFrame(
        [(f"M{i}", "a" if i < 2 else "b", 1, T0 + timedelta(days=i), "production") for i in range(6)],
        "model_id string, dataset string, version int, created_at timestamp, stage string",
    )
    assert [r.model_id for r in R.list_models(df, "a", 1).collect()] == ["M1"]
    with pytest.raises(ValueError, match="limit"):
        R.list_models(df, n=0)
    assert R.latest_production(df, by=()).first().model_id == "M5"
    assert {r.model_id for r in R.recent_production(df).collect()} == {"M0", "M1", "M4", "M5"}


def test_top_per_group_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = R.top_per_group(df, ["g"], ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_compliance_and_grid_survive_list_metrics(spark):
    ddl = "model_id string, name string, version int, dataset string, stage string, metrics string"
    df = spark.createDataFrame(
        [("a", "a", 1, "d", "production", '{"accuracy": 0.8, "f1_score": 0.75, "roc_curve_fpr": [0, 1]}'),
         ("b", "b", 1, "d", "production", '{"accuracy": [1]}'), ("c", "c", 1, "d", "staging", "{}")], ddl)
    assert [r.status for r in R.compliance(df).orderBy("model_id").collect()] == ["compliant", "non_compliant"]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    h = L.dataset_version(df, "d").first()
    assert h.hash == L.dataset_version(df.orderBy(F.desc("x")).repartition(3), "d").first().hash
    assert h.hash != L.dataset_version(df.distinct(), "d").first().hash
    assert h.hash != L.dataset_version(df.na.fill(""), "d").first().hash
    assert h.hash != L.dataset_version(df.withColumnRenamed(df.columns[0], "other"), "d").first().hash
    a, b = [spark.createDataFrame([r], "a string, b string, c string") for r in (("a|b", "c", None), ("a", "b|c", "~"))]
    assert L.dataset_version(a, "d").first().hash != L.dataset_version(b, "d").first().hash
    assert h.missing_values_summary == '{"x":0,"y":2}'


def test_schema_change(spark):
    a = L.schema_snapshot(spark.createDataFrame([(1.0, 1)], "f double, gone int"), 1)
    b = L.schema_snapshot(spark.createDataFrame([(1, "t")], "f bigint, fresh string"), 2)
    c = L.schema_change(a, b).first()
    assert (c.added_columns, c.removed_columns, c.dtype_changes) == (["fresh"], ["gone"], ["f:double->bigint"])


def test_prediction_log(spark):
    reqs = spark.createDataFrame([("r1", [0.5, 0.25]), ("r2", [])], "request_id string, predictions array<double>")
    rows = H.prediction_rows(reqs)
    assert [(r.request_id, r.row_index, r.prediction) for r in rows.collect()] == [("r1", 0, "0.5"), ("r1", 1, "0.25")]
    detail = H.request_detail(reqs.select("request_id"), rows)
    assert {(r.request_id, r.row_index) for r in detail.collect()} == {("r1", 0), ("r1", 1), ("r2", None)}
    with pytest.raises(ValueError, match="limit"):
        H.history(reqs, 5000)
    assert H.request_detail(reqs.select("request_id"), rows, "zz").count() == 0
    pages = H.request_pages(reqs.select("request_id"), rows, page_size=1)
    assert pages.where("request_id = 'r1'").count() == 2


def test_due_schedules(spark):
    df = spark.createDataFrame(
        [(1, True, "2024-01-01T11:00:00Z"), (2, True, "2024-01-02 12:00:00"), (3, False, None), (4, True, None), (5, True, "soon")],
        "id int, enabled boolean, next_run_at string",
    )
    assert {r.id for r in G.due_schedules(df, datetime(2024, 1, 1, 12)).collect()} == {1, 4, 5}


def test_schemas_parse(spark):
    for name in schemas.REGISTRY:
        assert len(schemas.schema(name)) > 2
    with pytest.raises(ValueError, match="Unknown registry table"):
        schemas.schema("nope")
