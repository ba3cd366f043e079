"""Drift queries: lineitem before and after 1998, events by day, embedding dimensions by label.

"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.functions.columns import vector_width
from mlwatch.operators import drift as D
from mlwatch.operators.frames import shared_dir
from mlwatch.plans.register import query, table
from mlwatch.sources.tables import DriftReference, save_report, write_alerts

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FIRST_WEEK_END = "timestamp_ntz'2024-01-08'"


def lineitem_sides(spark: SparkSession, d: str, shift: float = 5000.0) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem").select("l_shipdate", *FEATURES)
    cut = "timestamp_ntz'1998-01-01'"
    ref = li.where(f"l_shipdate < {cut}").select(*FEATURES)
    cur = li.where(f"l_shipdate >= {cut}").withColumn("l_extendedprice", F.col("l_extendedprice") + shift)
    return ref, cur.select(*FEATURES)


def event_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, d, "events").select("ts", "event_type", "value")
    return ev.where(f"ts < {FIRST_WEEK_END}"), ev.where(f"ts >= {FIRST_WEEK_END}")


def drift_sql(src: str, keys: str) -> str:
    """SQL of the per-feature report over ``src`` (side, keys..., value); ``keys`` ends in the feature."""
    on = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
    src AS ({src}),
    st AS (
      SELECT {keys}, count(*) FILTER (side = 0) AS nr, count(*) FILTER (side = 1) AS nc,
             min(value) AS lo, max(value) AS hi
      FROM src GROUP BY ALL),
    st2 AS (SELECT *, greatest(2, least(10, least(nr, nc) // 15)) AS nb FROM st),
    edges AS (
      SELECT *, [k * ((hi - lo) / nb) + lo for k in range(1, nb)] AS e FROM st2),
    binned AS (
      SELECT {a_keys}, len([x for x in b.e if x <= a.value]) AS bin,
             count(*) FILTER (a.side = 0) AS r, count(*) FILTER (a.side = 1) AS c
      FROM src a JOIN edges b ON {on} GROUP BY ALL),
    grid AS (SELECT {keys}, nr, nc, nb, lo, hi, unnest(range(0, nb)) AS bin FROM st2),
    filled AS (
      SELECT {a_keys}, a.nr, a.nc, a.lo, a.hi,
             (coalesce(b.r, 0) + 1.0) / (a.nr + a.nb) AS rp, (coalesce(b.c, 0) + 1.0) / (a.nc + a.nb) AS cp
      FROM grid a LEFT JOIN binned b ON {on} AND a.bin = b.bin),
    psi AS (
      SELECT {keys},
             CASE WHEN any_value(nr) >= 2 AND any_value(nc) >= 2 AND any_value(hi) > any_value(lo)
                  THEN round(sum((cp - rp) * ln(cp / rp)), 5) ELSE 0.0 END AS psi
      FROM filled GROUP BY ALL),
    vals AS (
      SELECT {keys}, value, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c
      FROM src GROUP BY ALL),
    cum AS (
      SELECT {keys}, sum(r) OVER w AS r, sum(c) OVER w AS c
      FROM vals WINDOW w AS (PARTITION BY {keys} ORDER BY value)),
    ks AS (
      SELECT {a_keys}, max(abs(a.r::DOUBLE / b.nr - a.c::DOUBLE / b.nc)) AS d,
             sqrt(any_value(b.nr)::DOUBLE * any_value(b.nc) / (any_value(b.nr) + any_value(b.nc))) AS root
      FROM cum a JOIN st2 b ON {on} GROUP BY ALL),
    pv AS (
      SELECT *, CASE WHEN d * root < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
               2 * list_sum([CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * (d * root) * (d * root))
                            for k in range(1, 101)]))) END AS p
      FROM ks),
    report AS (
      SELECT {a_keys}, round(a.d, 5) AS ks_statistic, round(a.p, 5) AS p_value, b.psi,
             a.p < 0.05 OR b.psi > 0.1 AS drift_detected,
             CASE WHEN b.psi > 0.25 OR a.p < 0.01 THEN 'significant'
                  WHEN b.psi > 0.1 OR a.p < 0.05 THEN 'moderate' ELSE 'none' END AS severity
      FROM pv a JOIN psi b ON {on})"""


def summary_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
    s AS (
      SELECT {k}count(*) AS n, count(*) FILTER (drift_detected) AS dr, avg(psi) AS a,
             count(*) FILTER (drift_detected) / count(*) AS ratio
      FROM report GROUP BY ALL),
    summary AS (
      SELECT {k}n AS features_analyzed, dr AS features_drifted, round(ratio, 4) AS drift_ratio,
             ratio > 0.20 AS overall_drift,
             CASE WHEN ratio >= 0.5 OR a >= 0.25 THEN 'critical'
                  WHEN ratio >= 0.2 OR a >= 0.1 THEN 'warning' ELSE 'stable' END AS overall_severity,
             round(a, 5) AS average_psi
      FROM s)"""


_LONG = """
      SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS side, feature, value
      FROM (SELECT l_shipdate, l_quantity,
                   l_extendedprice + CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 5000.0::DOUBLE
                                          ELSE 0.0::DOUBLE END AS l_extendedprice,
                   l_discount, l_tax FROM lineitem)
      UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))"""
_WITH = f"WITH {drift_sql(_LONG, 'feature')}"
_WEEKS = """
      SELECT 1 AS side, event_type, date_trunc('day', ts) AS window_start, 'value' AS feature, value
      FROM events WHERE ts >= TIMESTAMP '2024-01-08'
      UNION ALL
      SELECT 0 AS side, r.event_type, w.window_start, 'value' AS feature, r.value
      FROM events r
      JOIN (SELECT DISTINCT event_type, date_trunc('day', ts) AS window_start
            FROM events WHERE ts >= TIMESTAMP '2024-01-08') w ON r.event_type = w.event_type
      WHERE r.ts < TIMESTAMP '2024-01-08'"""
_BY_DAY = f"WITH {drift_sql(_WEEKS, 'event_type, window_start, feature')}"
_DIMS = """
      SELECT CASE WHEN label = 0 THEN 0 ELSE 1 END AS side, 'd' || (pos - 1) AS feature, v::DOUBLE AS value
      FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)"""


@query("drift_features", f"{_WITH} SELECT * FROM report")
def drift_features(spark, d):
    ref, cur = lineitem_sides(spark, d)
    return D.drift_features(ref, cur, FEATURES)


@query("drift_summary", f"{_WITH}, {summary_sql()} SELECT * FROM summary")
def drift_summary(spark, d):
    return D.drift_summary(drift_features(spark, d))


@query("psi", f"{_WITH} SELECT feature, psi FROM psi")
def psi(spark, d):
    ref, cur = lineitem_sides(spark, d)
    return D.psi(ref, cur, FEATURES)


@query("ks", f"{_WITH} SELECT feature, round(d, 6) AS ks_statistic, round(p, 6) AS p_value FROM pv")
def ks(spark, d):
    ref, cur = lineitem_sides(spark, d)
    out = D.ks(ref, cur, FEATURES)
    return out.select(
        "feature", F.round("ks_statistic", 6).alias("ks_statistic"), F.round("p_value", 6).alias("p_value")
    )


@query("drift_by_day", f"{_BY_DAY} SELECT * FROM report")
def drift_by_day(spark, d):
    ref, cur = event_sides(spark, d)
    return D.drift_by_window(ref, cur, "ts", "1 day", ["value"], by=["event_type"])


@query("drift_summary_by_day", f"{_BY_DAY}, {summary_sql('window_start')} SELECT * FROM summary")
def drift_summary_by_day(spark, d):
    return D.drift_summary(drift_by_day(spark, d), by=["window_start"])


@query(
    "drift_alerts",
    f"""{_BY_DAY}, {summary_sql('window_start')}
    SELECT overall_severity AS severity,
           'Data drift detected for dataset=events ' || strftime(window_start, '%Y-%m-%d') || '; ratio='
             || printf('%.2f', drift_ratio) AS message,
           features_drifted
    FROM summary WHERE overall_drift""",
)
def drift_alerts(spark, d):
    summary = drift_summary_by_day(spark, d)
    name = F.concat(F.lit("events "), F.date_format("window_start", "yyyy-MM-dd"))
    out = D.drift_alerts(summary, name)
    return out.select(
        "severity", "message", F.get_json_object("metadata", "$.features_drifted").cast("bigint").alias("features_drifted")
    )


@query(
    "drift_history",
    f"""{_BY_DAY}, {summary_sql('window_start')}
    SELECT strftime(window_start, '%Y%m%d') AS report_id, window_start AS created_at, features_drifted, average_psi
    FROM summary ORDER BY window_start DESC LIMIT 15""",
)
def drift_history(spark, d):
    s = drift_summary_by_day(spark, d)
    reports = s.select(
        F.date_format("window_start", "yyyyMMdd").alias("report_id"),
        F.col("window_start").alias("created_at"),
        "features_drifted",
        "average_psi",
    )
    return D.drift_history(reports, 15)


@query(
    "drift_significant",
    f"{_BY_DAY} SELECT event_type, count(*) FILTER (severity = 'significant') AS significant_features "
    "FROM report GROUP BY ALL",
)
def drift_significant(spark, d):
    return D.significant_count(drift_by_day(spark, d), by=["event_type"])


@query("drift_embeddings", f"WITH {drift_sql(_DIMS, 'feature')} SELECT feature, psi, drift_detected, severity FROM report")
def drift_embeddings(spark, d):
    emb = table(spark, d, "embeddings")
    width = vector_width(emb, "embedding")
    dims = emb.select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"d{i}") for i in range(width)])
    cols = [f"d{i}" for i in range(width)]
    out = D.drift_features(dims.where("label = 0"), dims.where("label <> 0"), cols)
    return out.select("feature", "psi", "drift_detected", "severity")


@query(
    "drift_health",
    f"""{_WITH}, {summary_sql()}
    SELECT average_psi, floor(100 - least(average_psi * 2, 1) * 100)::INTEGER AS health_score,
           CASE WHEN floor(100 - least(average_psi * 2, 1) * 100) > 75 THEN 'STABLE' ELSE 'DRIFTED' END AS health_label
    FROM summary""",
)
def drift_health(spark, d):
    return D.drift_health(drift_summary(spark, d)).select("average_psi", "health_score", "health_label")


@query(
    "perturb_shift",
    "SELECT count(*) AS n, round(sum(l_quantity + 2.5), 2) AS quantity, round(sum(l_tax + 2.5), 2) AS tax FROM lineitem",
)
def perturb_shift(spark, d):
    out = D.perturb(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], noise=0.0, shift=2.5)
    return out.agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_tax"), 2).alias("tax")
    )


@query("drift_common", f"{_WITH} SELECT * FROM report")
def drift_common(spark, d):
    """The numeric columns that both sides share, found by the operator."""
    ref, cur = lineitem_sides(spark, d)
    return D.drift_features(ref.withColumn("only_ref", F.lit(1)), cur.withColumns({"only_cur": F.lit(2), "note": F.lit("text")}))


@query("drift_stored", f"{_WITH} SELECT * FROM report")
def drift_stored(spark, d):
    """Current data against a reference that the first scan has stored; the report is saved and read back."""
    ref, cur = lineitem_sides(spark, d)
    root = f"{shared_dir(spark)}/drift/{uuid.uuid4().hex}"
    store = DriftReference(spark, f"{root}/references")
    store.get_or_create("lineitem", ref)
    known = store.get_or_create("lineitem", cur)
    save_report(D.drift_features(known, cur, FEATURES), f"{root}/reports", {"report_id": "R1"})
    return spark.read.parquet(f"{root}/reports").where("report_id = 'R1'").drop("report_id")


@query(
    "alerts_written",
    f"""{_BY_DAY}, {summary_sql('window_start')}
    SELECT overall_severity AS severity, 'Data drift detected for dataset=events ' || strftime(window_start, '%Y-%m-%d')
      || '; ratio=' || printf('%.2f', drift_ratio) AS message FROM summary WHERE overall_drift""",
)
def alerts_written(spark, d):
    """Drift alerts as JSON lines, read back."""
    name = F.concat(F.lit("events "), F.date_format("window_start", "yyyy-MM-dd"))
    path = f"{shared_dir(spark)}/alerts/{uuid.uuid4().hex}"
    write_alerts(D.drift_alerts(drift_summary_by_day(spark, d), name).select("severity", "message"), path)
    return spark.read.schema("severity string, message string").json(path)
