"""Telemetry, alert and log queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.functions.text import alert_level, error_category
from mlwatch.operators import alerting as A
from mlwatch.operators import telemetry as T
from mlwatch.plans.register import query, table
from mlwatch.sources import logs as G

BOUNDS = T.BUCKETS["stage"]


def hist_sql(src: str, keys: str) -> str:
    rows = " UNION ALL ".join(
        [f"SELECT {keys}, {float(b)}::DOUBLE AS le, count(*) FILTER (value <= {b}) AS bucket_count FROM {src} GROUP BY ALL" for b in BOUNDS]
        + [f"SELECT {keys}, 'inf'::DOUBLE, count(*) FROM {src} GROUP BY ALL"]
    )
    return rows


def quantile_sql(src: str, keys: str, q: float = 0.95) -> str:
    """Interpolated quantile from the cumulative buckets of ``src`` (keys, value)."""
    return f"""
    h AS ({hist_sql(src, keys)}),
    l AS (SELECT *, lag(le) OVER w AS lower, coalesce(lag(bucket_count) OVER w, 0) AS below,
                 {q} * max(bucket_count) OVER (PARTITION BY {keys}) AS rank
          FROM h WINDOW w AS (PARTITION BY {keys} ORDER BY le)),
    qs AS (SELECT {keys}, CASE WHEN le = 'inf'::DOUBLE THEN lower
             ELSE coalesce(lower, 0) + (le - coalesce(lower, 0)) * (rank - below) / (bucket_count - below) END AS quantile
           FROM l WHERE bucket_count >= rank AND (below < rank OR lower IS NULL))"""


@query("counters", "SELECT event_type, user_id % 10 AS shard, count(*) AS total FROM events GROUP BY ALL")
def counters(spark, d):
    ev = table(spark, d, "events").withColumn("shard", F.col("user_id") % 10)
    return T.counter(ev, ["event_type", "shard"])


@query(
    "gauge",
    """SELECT event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY event_type""",
)
def gauge(spark, d):
    return T.gauge(table(spark, d, "events"), ["event_type"], "value", "ts", "event_id")


@query(
    "histogram",
    f"""WITH h AS ({hist_sql('events', 'event_type')}),
    t AS (SELECT event_type, count(*) AS total, round(sum(value), 4) AS sum FROM events GROUP BY event_type)
    SELECT h.event_type, le, bucket_count, total, sum FROM h JOIN t ON h.event_type = t.event_type""",
)
def histogram(spark, d):
    return T.histogram(table(spark, d, "events"), "value", BOUNDS, ["event_type"]).withColumn("sum", F.round("sum", 4))


@query(
    "bucket_p95",
    f"WITH {quantile_sql('events', 'event_type')} SELECT event_type, round(quantile, 6) AS quantile FROM qs",
)
def bucket_p95(spark, d):
    h = T.histogram(table(spark, d, "events"), "value", BOUNDS, ["event_type"])
    return T.bucket_quantile(h, 0.95, ["event_type"]).withColumn("quantile", F.round("quantile", 6))


@query(
    "event_rate",
    """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE
      AS window_end, event_type, count(*) AS events, round(count(*) / 300, 8) AS per_second FROM events GROUP BY ALL""",
)
def event_rate(spark, d):
    out = T.rate(table(spark, d, "events"), "ts", ["event_type"])
    return out.withColumn("per_second", F.round("per_second", 8))


@query(
    "event_rate_sliding",
    """WITH p AS (SELECT date_trunc('minute', ts) AS m, event_type FROM events),
    w AS (SELECT m - to_minutes(k) AS window_start, event_type FROM p, range(0, 5) t(k))
    SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, event_type, count(*) AS events,
           round(count(*) / 300, 8) AS per_second FROM w GROUP BY ALL""",
)
def event_rate_sliding(spark, d):
    out = T.rate(table(spark, d, "events"), "ts", ["event_type"], 300, 60)
    return out.withColumn("per_second", F.round("per_second", 8))


STATUS = """(SELECT user_id % 5 AS endpoint, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 404 ELSE 200 END AS status
             FROM events)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", 500).when(kind == "view", 404).otherwise(200)
    return table(spark, d, "events").select((F.col("user_id") % 5).alias("endpoint"), status.alias("status"))


@query(
    "error_rate",
    f"""SELECT endpoint, count(*) FILTER (status < 400) AS succeeded, count(*) FILTER (status >= 400) AS failed,
      round(avg((status >= 400)::INTEGER), 6) AS error_rate FROM {STATUS} GROUP BY endpoint""",
)
def error_rate(spark, d):
    out = T.error_rate(responses(spark, d), T.http_error(F.col("status")), by=["endpoint"])
    return out.withColumn("error_rate", F.round("error_rate", 6))


@query(
    "error_counts",
    f"SELECT endpoint, 'http_' || status AS error_type, count(*) AS errors FROM {STATUS} WHERE status >= 400 GROUP BY ALL",
)
def error_counts(spark, d):
    return T.error_counts(responses(spark, d), T.http_error(F.col("status")), by=["endpoint"])


@query(
    "stage_durations",
    """WITH s AS (SELECT event_type AS model_type, 'Training' AS stage, value AS s FROM events
                  UNION ALL SELECT event_type, 'Evaluation', value / 2 FROM events)
    SELECT model_type, stage, count(*) AS runs, round(sum(s), 4) AS total_seconds, round(avg(s), 4) AS avg_seconds,
           round(max(s), 4) AS max_seconds,
           count(*) FILTER (stage = 'Training' AND s > 100) AS failed
    FROM s GROUP BY model_type, stage""",
)
def stage_durations(spark, d):
    v = F.col("value")

    def stage(name, status, seconds):
        return F.struct(F.lit(name).alias("name"), status.alias("status"), seconds.alias("duration"))

    ok = F.lit("success")
    runs = table(spark, d, "events").select(
        F.col("event_type").alias("model_type"),
        F.array(
            stage("Training", F.when(v > 100, "failed").otherwise(ok), v), stage("Evaluation", ok, v / 2)
        ).alias("stages"),
    )
    out = T.stage_durations(runs, ["model_type", "stage"])
    return out.withColumns({c: F.round(c, 4) for c in ("total_seconds", "avg_seconds", "max_seconds")})


_ERROR_CASE = """CASE WHEN e IN ('ValueError', 'KeyError', 'TypeError') THEN 'validation_error'
      WHEN e IN ('FileNotFoundError', 'PermissionError') THEN 'configuration_error'
      WHEN contains(t, 'database') OR contains(t, 'sql') OR contains(t, 'connection') THEN 'database_error'
      WHEN contains(t, 'model') OR contains(t, 'artifact') OR contains(t, 'joblib') THEN 'model_error'
      WHEN contains(t, 'pipeline') OR contains(t, 'stage') THEN 'pipeline_error'
      WHEN contains(t, 'drift') OR contains(t, 'psi') OR contains(t, 'kolmogorov') THEN 'drift_error'
      WHEN contains(t, 'auth') OR contains(t, 'login') OR contains(t, 'credential') THEN 'authentication_error'
      WHEN contains(t, 'unauthorized') OR contains(t, 'forbidden') OR contains(t, 'permission') THEN 'authorization_error'
      WHEN contains(t, 'mlflow') OR contains(t, 'external') THEN 'external_service_error'
      ELSE 'internal_error' END"""


@query(
    "error_category",
    f"""SELECT {_ERROR_CASE} AS category, count(*) AS n FROM (
      SELECT lower(text) AS t, CASE doc_id % 10 WHEN 0 THEN 'KeyError' WHEN 1 THEN 'PermissionError' ELSE 'RuntimeError' END
        AS e FROM documents) GROUP BY ALL""",
)
def error_categories(spark, d):
    k = F.col("doc_id") % 10
    kind = F.when(k == 0, "KeyError").when(k == 1, "PermissionError").otherwise("RuntimeError")
    docs = table(spark, d, "documents").select(error_category(kind, F.col("text")).alias("category"))
    return T.counter(docs, ["category"]).withColumnRenamed("total", "n")


# Alerts -------------------------------------------------------------------------------------------------------


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts_of(table(spark, d, "events"))


def alerts_of(events: DataFrame) -> DataFrame:
    v = F.col("value")
    return events.select(
        "event_id",
        "ts",
        F.col("event_type").alias("alertname"),
        F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 30).cast("string")).alias("job"),
        F.when(v > 150, "critical").when(v > 40, "warning").otherwise("info").alias("severity"),
    )


ALERTS = """
    al AS (SELECT event_id, ts, event_type AS alertname, CASE WHEN user_id % 7 <> 0 THEN (user_id % 30)::VARCHAR END AS job,
                  CASE WHEN value > 150 THEN 'critical' WHEN value > 40 THEN 'warning' ELSE 'info' END AS severity
           FROM events)"""


@query(
    "alert_level",
    f"""WITH {ALERTS} SELECT CASE severity WHEN 'critical' THEN 'error' ELSE severity END AS level, count(*) AS n
    FROM al GROUP BY ALL""",
)
def alert_levels(spark, d):
    spelled = F.concat(F.lit(" "), F.upper("severity"), F.lit("  "))
    return alerts(spark, d).groupBy(alert_level(spelled).alias("level")).agg(F.count("*").alias("n"))


@query(
    "flatten_alerts",
    """SELECT event_id, event_type AS alertname, CASE WHEN value > 40 THEN 'warning' ELSE 'unknown' END AS severity,
      'user ' || user_id AS summary, '' AS description, CASE WHEN user_id % 2 = 0 THEN 'resolved' ELSE 'firing' END AS status
    FROM events""",
)
def flatten_alerts(spark, d):
    labels = F.struct(F.col("event_type").alias("alertname"), F.when(F.col("value") > 40, "warning").alias("severity"))
    notes = F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("summary"))
    alert = F.struct(
        labels.alias("labels"), notes.alias("annotations"), F.when(F.col("user_id") % 2 == 0, "resolved").alias("status")
    )
    body = F.to_json(F.struct(F.lit("firing").alias("status"), F.array(alert).alias("alerts")))
    payloads = table(spark, d, "events").select("event_id", body.alias("body"))
    return A.flatten_alerts(payloads, "body", keep=["event_id"])


@query(
    "group_alerts",
    f"""WITH {ALERTS} SELECT alertname, job, severity, count(*) AS alerts, min(ts) AS first_at, max(ts) AS last_at
    FROM al GROUP BY ALL""",
)
def group_alerts(spark, d):
    return A.group_alerts(alerts(spark, d))


@query(
    "inhibit",
    f"""WITH {ALERTS} SELECT event_id, severity FROM al a WHERE NOT (severity = 'warning' AND EXISTS (
      SELECT 1 FROM al c WHERE c.severity = 'critical' AND c.alertname = a.alertname
        AND c.job IS NOT DISTINCT FROM a.job AND c.ts <= a.ts AND a.ts < c.ts + INTERVAL 5 MINUTE))""",
)
def inhibit(spark, d):
    return A.inhibit(alerts(spark, d)).select("event_id", "severity")


DEDUP_SQL = f"""WITH RECURSIVE {ALERTS},
    sent AS (SELECT alertname, job, severity, min(ts) AS ts FROM al GROUP BY ALL
             UNION ALL
             SELECT s.alertname, s.job, s.severity, min(a.ts) FROM sent s JOIN al a
               ON a.alertname = s.alertname AND a.severity = s.severity AND a.job IS NOT DISTINCT FROM s.job
                  AND a.ts >= s.ts + INTERVAL 1 HOUR GROUP BY s.alertname, s.job, s.severity, s.ts)
    SELECT min(a.event_id) AS event_id FROM sent s JOIN al a
      ON a.alertname = s.alertname AND a.severity = s.severity AND a.job IS NOT DISTINCT FROM s.job AND a.ts = s.ts
    GROUP BY a.alertname, a.job, a.severity, a.ts"""


@query("dedup_repeat", DEDUP_SQL)
def dedup_repeat(spark, d):
    return A.dedup_repeat(alerts(spark, d)).select("event_id")


# Logs ---------------------------------------------------------------------------------------------------------


def log_lines(events: DataFrame) -> DataFrame:
    """events as JSON log lines."""
    kind = F.col("event_type")
    line = F.to_json(
        F.struct(
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("timestamp"),
            F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"),
            F.concat(F.lit("app."), kind).alias("logger"),
            F.when(F.col("value") > 100, "database connection lost").otherwise("done").alias("message"),
            (F.col("user_id") % 50).cast("string").alias("correlation_id"),
            kind.alias("operation"),
            F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string")).alias("service"),
            F.when(kind == "purchase", "prediction_request").when(kind == "signup", "dataset_validation").alias("event"),
            F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("model_id"),
            F.col("value").alias("duration_ms"),
            (F.col("event_id") % 7).alias("num_predictions"),
            F.lit("ok").alias("status"),
        )
    )
    return events.select(line.alias("value"), "event_id")


def damaged(lines: DataFrame) -> DataFrame:
    """The lines with every hundredth cut off in the middle."""
    cut = F.when(F.col("event_id") % 100 == 99, F.substring("value", 1, 40)).otherwise(F.col("value"))
    return lines.select(cut.alias("value"))


LOGS = """
    lg AS (SELECT epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
                  event_type AS operation, 'svc' || (user_id % 3) AS service, (user_id % 50)::VARCHAR AS correlation_id,
                  user_id, value, event_id, date_trunc('millisecond', ts) AS ts,
                  CASE WHEN value > 100 THEN 'database connection lost' ELSE 'done' END AS message
           FROM events)"""


@query(
    "log_rollup",
    f"""WITH {LOGS} SELECT level, operation, service, count(*) AS records, min(ms) AS first_ms, max(ms) AS last_ms
    FROM lg GROUP BY ALL""",
)
def log_rollup(spark, d):
    logs = G.parse_logs(log_lines(table(spark, d, "events")))
    out = G.log_rollup(logs, by=["level", "operation", "service"])
    return out.select(
        "level", "operation", "service", "records",
        F.unix_millis("first_at").alias("first_ms"), F.unix_millis("last_at").alias("last_ms"),
    )


@query(
    "log_trace",
    f"""WITH {LOGS} SELECT correlation_id, count(*) AS records, count(*) FILTER (level = 'ERROR') AS errors,
      min(ms) AS started_ms, round((max(ms) - min(ms)) / 1000, 3) AS seconds FROM lg GROUP BY correlation_id""",
)
def log_trace(spark, d):
    out = G.trace(G.parse_logs(log_lines(table(spark, d, "events"))))
    return out.select(
        "correlation_id", "records", "errors",
        F.unix_millis("started_at").alias("started_ms"), F.round("seconds", 3).alias("seconds"),
    )


@query(
    "log_events",
    f"""WITH {LOGS} SELECT ms, 'M' || user_id AS model_id, event_id % 7 AS num_predictions, value AS duration_ms,
      'ok' AS status FROM lg WHERE operation = 'purchase'""",
)
def log_events(spark, d):
    out = G.log_events(G.parse_logs(log_lines(table(spark, d, "events"))), "prediction_request")
    return out.select(
        F.unix_millis("timestamp").alias("ms"), "model_id", "num_predictions", "duration_ms", "status"
    )


@query("log_corrupt", "SELECT count(*) AS corrupt FROM events WHERE event_id % 100 = 99")
def log_corrupt(spark, d):
    logs = G.parse_logs(damaged(log_lines(table(spark, d, "events"))))
    return logs.agg(F.count("_corrupt_record").alias("corrupt"))
