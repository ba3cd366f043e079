from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mlwatch.functions.text import alert_level, error_category
from mlwatch.operators import alerting as A
from mlwatch.operators import telemetry as T
from mlwatch.sources import logs as G
from mlwatch.sources import tables as S
from mlwatch.streaming import stages as M
from mlwatch.streaming import windows as X
from mlwatch.streaming.run import run_available
from tests.test_records import fold, random_requests

T0 = datetime(2024, 1, 1)


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (4.0,), (50.0,), (1000.0,)], "v double")
    h = T.histogram(df, "v", (1, 5, 60))
    assert [(r.le, r.bucket_count) for r in h.orderBy("le").collect()] == [(1.0, 1), (5.0, 3), (60.0, 4), (float("inf"), 5)]
    assert T.bucket_quantile(h, 0.5).first()[0] == pytest.approx(1 + 4 * 1.5 / 2)
    assert T.bucket_quantile(h, 0.99).first()[0] == 60.0
    wide = df.agg(F.count("v").alias("total"), *T.bucket_counts(F.col("v"), (1, 5, 60)))
    for q in (0.1, 0.5, 0.75, 0.99):
        assert wide.select(T.wide_quantile(q, (1, 5, 60))).first()[0] == pytest.approx(T.bucket_quantile(h, q).first()[0])


def test_sliding_rate_equals_direct_windows(spark):
    df = spark.range(500).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7)).alias("ts"))
    a = T.rate(df, "ts", (), 300, 60).select("window_start", "events")
    b = df.groupBy(F.window("ts", "300 seconds", "60 seconds").alias("w")).count().select("w.start", "count")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        T.rate(df, "ts", (), 300, 70)


def test_error_rules_in_order(spark):
    rows = [
        ("ValueError", "database down", "validation_error"), ("PermissionError", "x", "configuration_error"),
        ("X", "SQL model", "database_error"), ("X", "stage of the model", "model_error"), ("X", "bad stage", "pipeline_error"),
        ("X", "Kolmogorov", "drift_error"), ("X", "unauthorized", "authentication_error"),
        ("X", "forbidden", "authorization_error"), ("X", "external", "external_service_error"), ("X", None, "internal_error"),
    ]
    df = spark.createDataFrame(rows, "t string, m string, want string")
    assert df.where(error_category(F.col("t"), F.col("m")) != F.col("want")).count() == 0


def test_alert_levels(spark):
    df = spark.createDataFrame([(" CRITICAL ", "error"), ("warn", "warning"), ("note", "info"), (None, "info")], "s string, want string")
    assert df.where(alert_level(F.col("s")) != F.col("want")).count() == 0


def test_flatten_alerts_falls_back(spark):
    body = '{"status":"firing","alerts":[{"labels":{"alertname":"A","severity":"critical"},"status":"resolved","annotations":{"summary":"s"}},{"labels":{}}]}'
    rows = A.flatten_alerts(spark.createDataFrame([(body,), ("{}",)], "b string"), "b").collect()
    assert [tuple(r) for r in rows] == [("A", "critical", "s", "", "resolved"), ("unknown", "unknown", "", "", "firing")]


def test_inhibit_and_repeat(spark):
    rows = [(1, "A", None, "critical", 0), (2, "A", None, "warning", 4), (3, "A", "j", "warning", 6), (4, "A", None, "info", 7),
            (5, "A", None, "critical", 50), (6, "A", None, "critical", 111)]
    df = spark.createDataFrame([(i, n, j, s, T0 + timedelta(minutes=m)) for i, n, j, s, m in rows],
                               "event_id int, alertname string, job string, severity string, ts timestamp")
    assert {r.event_id for r in A.inhibit(df).collect()} == {1, 3, 4, 5, 6}
    assert {r.event_id for r in A.dedup_repeat(df).collect()} == {1, 2, 3, 4, 6}


def test_repeat_runs_from_the_last_alert_sent(spark):
    minutes = [*range(0, 1500, 30), 1500 + 61, 1500 + 100, 5000]
    df = spark.createDataFrame([(i, "A", None, "critical", T0 + timedelta(minutes=m)) for i, m in enumerate(minutes)],
                               "event_id int, alertname string, job string, severity string, ts timestamp")
    want, last = [], None
    for i, m in enumerate(minutes):
        if last is None or m >= last + 60:
            want.append(i)
            last = m
    assert sorted(r.event_id for r in A.dedup_repeat(df).collect()) == want


@pytest.mark.parametrize("depth", [1, 40, 10**6])
def test_repeat_in_pieces(spark, depth):
    """Busy groups are cut in pieces; quiet ones, bursts within a second and times much denser than the interval agree with a plain loop."""
    rng = random.Random(depth)
    times = {
        "even": [60 * i for i in range(400)],
        "burst": [0.000001 * i for i in range(300)],
        "steps": [3600 * i for i in range(100)],
        "random": sorted(rng.uniform(0, 80_000) for _ in range(500)),
        "gaps": [100_000 * i + j for i in range(20) for j in (0, 3599, 3600, 7199.5)],
        "one": [5],
    }
    rows = [(i, g, None, "critical", T0 + timedelta(seconds=t)) for i, (g, t) in enumerate((g, t) for g, own in times.items() for t in own)]
    rows.append((10**6, "even", None, "critical", None))
    df = spark.createDataFrame(rows, "event_id int, alertname string, job string, severity string, ts timestamp").repartition(5)
    want, last = set(), {}
    for i, g, _, _, t in sorted(rows[:-1], key=lambda r: (r[1], r[4], r[0])):
        if g not in last or t >= last[g] + timedelta(hours=1):
            want.add(i)
            last[g] = t
    assert {r.event_id for r in A.dedup_repeat(df, depth=depth).collect()} == want


def test_warnings_after_a_critical_are_heard(spark):
    df = spark.createDataFrame([(i, "A", "j", s, T0 + timedelta(seconds=t)) for i, (s, t) in enumerate(
        [("warning", -1), ("critical", 0), ("warning", 0), ("warning", 299), ("warning", 300), ("info", 10), ("warning", 86400)])],
        "event_id int, alertname string, job string, severity string, ts timestamp")
    assert {r.event_id for r in A.inhibit(df).collect()} == {0, 1, 4, 5, 6}


def test_logs_roundtrip(spark, tmp_path):
    lines = [
        '{"timestamp":"2024-01-01T10:00:00.123Z","level":"INFO","logger":"a","message":"m","correlation_id":"c","event":"dataset_validation","rows":7,"issues":["x"]}',
        '{"timestamp":"2024-01-01T10:00:02.123Z","level":"ERROR","correlation_id":"c","exception":"ValueError: bad"}',
        "not json",
    ]
    (tmp_path / "l.log").write_text("\n".join(lines))
    logs = G.read_logs(spark, str(tmp_path))
    assert logs.where("_corrupt_record IS NOT NULL").count() == 1
    t = G.trace(logs).first()
    assert (t.records, t.errors, t.seconds) == (2, 1, 2.0)
    e = G.log_events(logs, "dataset_validation").first()
    assert (e.rows, e.issues) == (7, '["x"]')
    assert G.log_rollup(logs, ["level"]).count() == 3
    assert G.trace_lines(logs, "c").first().level == "INFO"


def test_log_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [f'{{"timestamp":"2024-01-01T10:{i:02d}:00.000Z","level":"{"ERROR" if i % 5 == 0 else "INFO"}","service":"s","message":"sql"}}' for i in range(60)]
    (tmp_path / "in" / "l.log").write_text("\n".join(rows))
    out = run_available(X.stream_log_errors(G.stream_logs(spark, str(tmp_path / "in"))))
    got = {r.window_start.minute: (r.records, r.errors, r.database_error) for r in out.collect()}
    assert got[0] == (5, 1, 1) and len(got) == 9


def test_named_data_sets(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "toy.parquet"))
    assert S.load(spark, str(tmp_path), "toy").count() == 3
    with pytest.raises(ValueError, match="no data set is named 'nope'"):
        S.load(spark, str(tmp_path), "nope")
    with pytest.raises(ValueError, match="needs a schema"):
        S.load(spark, str(tmp_path), "toy", "csv")


def test_split_cache(spark, tmp_path):
    assert len(S.feature_key("iris", 0.2, 42)) == 16
    assert S.feature_key("iris", 0.2, 42) == S.feature_key("iris", 0.20000001, 42) != S.feature_key("iris", 0.3, 42)
    df = spark.range(50).select("id", (F.col("id") % 2).alias("y"))
    a = S.cached_split(df, "d", ["id"], str(tmp_path), stratify="y")
    b = S.cached_split(df.limit(0), "d", ["id"], str(tmp_path), stratify="y")
    assert a.count() == b.count() == 50 and b.where("split = 'test'").count() == 10


def test_drift_reference(spark, tmp_path):
    ref = S.DriftReference(spark, str(tmp_path))
    assert ref.get("My data/1") is None
    assert ref.get_or_create("My data/1", spark.range(5)).count() == 5
    assert ref.get_or_create("My data/1", spark.range(9)).count() == 5
    assert ref.refresh("My data/1", spark.range(9)).count() == 9


def test_reports_and_alert_files(spark, tmp_path):
    df = spark.createDataFrame([("x", 0.1)], "feature string, psi double")
    S.save_report(df, str(tmp_path / "r"), {"report_id": "R1"})
    S.save_report(df, str(tmp_path / "r"), {"report_id": "R2"})
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    S.write_alerts(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).first().feature == "x"


def stream_of(spark, tmp_path, df, parts=3):
    df.repartition(parts).write.parquet(str(tmp_path / "src"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))


def test_stage_stream_equals_the_loop_across_batches(spark, tmp_path):
    reqs = sorted(random_requests(300), key=lambda r: (r[3], r[4]))
    ddl = "dataset string, model_id string, to_stage string, changed_at timestamp, event_id long"
    path = str(tmp_path / "src")
    for i in range(3):
        spark.createDataFrame(reqs[i * 100 : (i + 1) * 100], ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    out = M.stream_transitions(stream, str(tmp_path / "stages"), depth=20)
    assert out.select("batch").distinct().count() == 3
    got = sorted((r.dataset, r.model_id, r.from_stage, r.to_stage, r.event_id, r.ord) for r in out.collect())
    assert got == fold(reqs)[0]


def test_a_stage_batch_that_is_run_again_and_late_requests(spark, tmp_path):
    """A repeated batch replaces its rows; what arrives late is applied when it arrives; other data sets keep their state."""
    ddl = "dataset string, model_id string, to_stage string, changed_at timestamp, event_id long"
    batches = [
        [("a", "m1", "production", T0, 1), ("b", "x", "staging", T0, 2)],
        [("a", "m2", "production", T0 - timedelta(days=9), 3), ("a", "m1", "nonsense", T0, 4)],
        [("a", "m1", "staging", T0, 5), ("b", "x", "production", T0, 6), ("b", "y", "production", T0, 7)],
    ]
    write = M.stage_batch_writer(str(tmp_path))
    for i in (0, 1, 1, 2, 2):
        write(spark.createDataFrame(batches[i], ddl), i)
    log = spark.read.parquet(str(tmp_path / "log")).orderBy("event_id", "ord").collect()
    assert [(r.batch, r.dataset, r.model_id, r.from_stage, r.to_stage, r.event_id, r.ord) for r in log] == [
        (0, "a", "m1", "development", "production", 1, 1),
        (0, "b", "x", "development", "staging", 2, 1),
        (1, "a", "m1", "production", "staging", 3, 0),
        (1, "a", "m2", "development", "production", 3, 1),
        (2, "b", "x", "staging", "production", 6, 1),
        (2, "b", "x", "production", "staging", 7, 0),
        (2, "b", "y", "development", "production", 7, 1),
    ]
    state = spark.read.parquet(str(tmp_path / "state" / "batch=2")).collect()
    assert {(r.dataset, r.model_id, r.stage) for r in state} == {("a", "m1", "staging"), ("a", "m2", "production"), ("b", "x", "staging"), ("b", "y", "production")}


def test_repeat_suppression_stream(spark, tmp_path):
    rows = [(i, "A", "j", "critical", T0 + timedelta(minutes=7 * i)) for i in range(60)] + [(99, "B", None, "critical", T0)]
    df = spark.createDataFrame(rows, "event_id int, alertname string, job string, severity string, ts timestamp")
    write = X.dedup_batch_writer(str(tmp_path / "sent"))
    for batch in (0, 1, 2, 2):  # the last one is run again
        write(df.where(f"event_id % 99 BETWEEN {20 * batch} AND {20 * batch + 19}"), batch)
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "sent" / "sent"))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in A.dedup_repeat(df).collect())


def test_drift_batches(spark, tmp_path):
    ref = spark.range(300).select(F.randn(1).alias("x"))
    cur = spark.range(200).select((F.randn(2) + 4).alias("x"))
    stream = stream_of(spark, tmp_path, cur, 2)
    q = (
        stream.writeStream.foreachBatch(X.drift_batch_writer(ref, ["x"], str(tmp_path / "out")))
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and got.where("severity = 'significant'").count() == 2
