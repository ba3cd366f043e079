"""Streaming queries: the events table as a file stream, run over everything available.

Queries run in update mode and keep the newest state of every window, so that windows which are still open at the end of
the input are reported as well: each stream has the rows of its batch twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.operators.frames import shared_dir
from mlwatch.operators.telemetry import BUCKETS
from mlwatch.plans import signals
from mlwatch.plans.records import LOG, requests_of
from mlwatch.plans.register import query, table
from mlwatch.plans.signals import log_lines
from mlwatch.sources.logs import parse_logs
from mlwatch.sources.tables import stream_table
from mlwatch.streaming import stages as M
from mlwatch.streaming import windows as S
from mlwatch.streaming.run import last_emitted, run_available

BOUNDS = BUCKETS["stage"]


def events(spark: SparkSession, d: str) -> DataFrame:
    return stream_table(spark, d, "events", table(spark, d, "events").schema)


def newest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key once everything available is processed."""
    return last_emitted(run_available(stream, mode="update"), keys)


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """Times back in the type the tables use."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols}).drop("batch")


@query(
    "stream_rate",
    """WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS events
                  FROM events GROUP BY 1, 2)
    SELECT *, round(events / 300, 8) AS per_second FROM w""",
)
def stream_rate(spark, d):
    out = newest(S.stream_rate(S.with_event_time(events(spark, d)), "ts", ["event_type"]), ["window_start", "event_type"])
    return plain(out, "window_start").drop("window_end").withColumn("per_second", F.round("per_second", 8))


@query(
    "stream_rate_sliding",
    """WITH p AS (SELECT date_trunc('minute', ts) AS m, event_type FROM events),
    w AS (SELECT m - to_minutes(k) AS window_start, event_type FROM p, range(0, 5) t(k))
    SELECT window_start, event_type, count(*) AS events FROM w GROUP BY 1, 2""",
)
def stream_rate_sliding(spark, d):
    s = S.stream_rate(S.with_event_time(events(spark, d)), "ts", ["event_type"], 300, 60)
    out = newest(s, ["window_start", "event_type"])
    return plain(out, "window_start").select("window_start", "event_type", "events")


_HIST = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(BOUNDS))
_CASES = " ".join(
    f"WHEN b{i} >= 0.95 * total THEN {BOUNDS[i - 1] if i else 0} + "
    f"({b} - {BOUNDS[i - 1] if i else 0}) * (0.95 * total - {f'b{i - 1}' if i else 0}) / (b{i} - {f'b{i - 1}' if i else 0})"
    for i, b in enumerate(BOUNDS)
)


@query(
    "stream_histogram",
    f"""WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS total,
                          round(sum(value), 4) AS sum, {_HIST} FROM events GROUP BY ALL)
    SELECT *, round(CASE {_CASES} ELSE {BOUNDS[-1]} END, 6) AS quantile FROM h""",
)
def stream_histogram(spark, d):
    s = S.stream_histogram(S.with_event_time(events(spark, d)), "ts", "value", BOUNDS, ["event_type"], 3600)
    out = plain(newest(s, ["window_start", "event_type"]), "window_start")
    return out.withColumns({"sum": F.round("sum", 4), "quantile": F.round("quantile", 6)})


@query(
    "stream_gauge",
    "SELECT event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY event_type",
)
def stream_gauge(spark, d):
    s = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return plain(newest(S.stream_gauge(s, ["event_type"], "value", "ts", "event_id"), ["event_type"]), "at")


@query(
    "stream_drift",
    """WITH r AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-08'),
    s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS nr, greatest(2, least(10, count(*) // 15)) AS nb FROM r),
    e AS (SELECT *, [k * ((hi - lo) / nb) + lo for k in range(1, nb)] AS edges FROM s),
    rb AS (SELECT len([x for x in edges if x <= value]) AS bin, count(*) AS k FROM r, e GROUP BY 1),
    cb AS (SELECT date_trunc('day', ts) AS window_start, len([x for x in edges if x <= value]) AS bin, count(*) AS k
           FROM events, e GROUP BY ALL),
    g AS (SELECT window_start, sum(k) AS nc, unnest(range(0, (SELECT nb FROM s))) AS bin FROM cb GROUP BY window_start),
    f AS (SELECT g.window_start, g.nc, (coalesce(rb.k, 0) + 1.0) / (nr + nb) AS rp, (coalesce(cb.k, 0) + 1.0) / (g.nc + nb) AS cp
          FROM g CROSS JOIN s LEFT JOIN rb ON rb.bin = g.bin
          LEFT JOIN cb ON cb.bin = g.bin AND cb.window_start = g.window_start)
    SELECT window_start, 'value' AS feature, any_value(nc)::BIGINT AS n_cur, round(sum((cp - rp) * ln(cp / rp)), 5) AS psi
    FROM f GROUP BY window_start""",
)
def stream_drift(spark, d):
    bins = S.reference_bins(table(spark, d, "events").where("ts < timestamp_ntz'2024-01-08'"), ["value"])
    s = S.with_event_time(events(spark, d))
    return plain(newest(S.stream_drift(s, bins, "ts", ["value"]), ["window_start", "feature"]), "window_start")


@query(
    "stream_quality",
    """WITH q AS (SELECT quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM events
                   WHERE ts < TIMESTAMP '2024-01-08'),
    w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS rows, 'value' AS feature,
                 count(*) FILTER (value > 300) AS missing_count,
                 count(*) FILTER (value <= 300 AND (value < lo OR value > hi)) AS out_of_range
          FROM events, q GROUP BY 1)
    SELECT * FROM w""",
)
def stream_quality(spark, d):
    limits = S.quality_limits(table(spark, d, "events").where("ts < timestamp_ntz'2024-01-08'"), ["value"])
    s = S.with_event_time(events(spark, d)).withColumn("value", F.when(F.col("value") <= 300, F.col("value")))
    return plain(newest(S.stream_quality(s, "ts", limits), ["window_start", "feature"]), "window_start")


@query("stream_dedup", signals.DEDUP_SQL)
def stream_dedup(spark, d):
    sent = S.stream_dedup(signals.alerts_of(events(spark, d)), f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}")
    return sent.select("event_id")


@query(
    "stream_stages",
    f"WITH {LOG} SELECT dataset, model_id, from_stage, to_stage, changed_at, event_id, ord, note FROM log",
)
def stream_stages(spark, d):
    """The events arrive in four parts, one after the other in time, so that state passes through several batches."""
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    arriving = requests_of(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    cuts = arriving.agg(F.percentile_approx(F.unix_micros("changed_at"), [0.25, 0.5, 0.75])).first()[0] or []
    part = sum((F.unix_micros("changed_at") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    for i in range(len(cuts) + 1):
        arriving.where(F.coalesce(part, F.lit(0)) == i).coalesce(1).write.mode("append").parquet(f"{root}/arriving")
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/arriving")
    return plain(M.stream_transitions(stream, f"{root}/stages"), "changed_at")


@query(
    "stream_log_errors",
    """WITH l AS (SELECT *, date_trunc('millisecond', ts) AS ms, event_type = 'error' AS failed,
                         'svc' || (user_id % 3) AS service FROM events),
    w AS (SELECT time_bucket(INTERVAL 1 HOUR, ms) AS h, service, count(*) AS records,
                 count(*) FILTER (failed) AS errors, count(*) FILTER (failed AND value > 100) AS database_error,
                 count(*) FILTER (failed AND value <= 100) AS internal_error FROM l GROUP BY 1, 2)
    SELECT epoch_us(h) // 1000 AS window_ms, service, records, errors, round(errors / records, 6) AS error_rate,
           database_error, internal_error
    FROM w""",
)
def stream_log_errors(spark, d):
    logs = parse_logs(log_lines(events(spark, d)))
    out = newest(S.stream_log_errors(logs, 3600), ["window_start", "service"])
    return out.select(
        F.unix_millis("window_start").alias("window_ms"), "service", "records", "errors",
        F.round("error_rate", 6).alias("error_rate"), "database_error", "internal_error",
    )
