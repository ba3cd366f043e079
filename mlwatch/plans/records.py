"""Registry, lineage, prediction-log and governance queries over the shared tables.

orders stand for models (data set = priority, stage from status) and for experiment runs, events for stage
requests (data set = user number modulo ten, model = user) and user activity, conversations for prediction requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.operators import governance as G
from mlwatch.operators import lineage as L
from mlwatch.operators import predictions as H
from mlwatch.operators import profile as P
from mlwatch.operators import registry as R
from mlwatch.plans.register import query, table
from mlwatch.sources.tables import load


def models(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    stage = F.when(status == "F", "production").when(status == "O", "staging").otherwise("development")
    acc = F.round(F.col("o_totalprice") / 500000.0, 4)
    f1 = F.round(0.5 + (F.col("o_custkey") % 50) / 100.0, 4)
    key = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select(
        F.concat(F.lit("M"), key).alias("model_id"),
        F.concat(F.lit("R"), key).alias("run_id"),
        F.concat_ws("-", F.lit("model"), key).alias("name"),
        F.lit(1).alias("version"),
        F.col("o_orderpriority").alias("dataset"),
        F.concat(F.lit("algo"), (F.col("o_custkey") % 5).cast("string")).alias("model_type"),
        F.to_json(F.struct(acc.alias("accuracy"), f1.alias("f1_score"), F.array(acc, f1).alias("curve"))).alias("metrics"),
        stage.alias("stage"),
        F.col("o_orderdate").alias("created_at"),
    )


MODELS = """
    m AS (SELECT 'M' || o_orderkey AS model_id, 'R' || o_orderkey AS run_id, 'model-' || o_orderkey AS name,
                 o_orderpriority AS dataset, 'algo' || (o_custkey % 5) AS model_type,
                 round(o_totalprice / 500000.0, 4) AS accuracy, round(0.5::DOUBLE + (o_custkey % 50) / 100.0, 4) AS f1_score,
                 CASE o_orderstatus WHEN 'F' THEN 'production' WHEN 'O' THEN 'staging' ELSE 'development' END AS stage,
                 o_orderdate AS created_at FROM orders)"""


@query(
    "register_versions",
    f"""WITH {MODELS}, v AS (
      SELECT *, row_number() OVER w AS version, lag(model_id) OVER w AS parent_model_id FROM m
      WINDOW w AS (PARTITION BY dataset ORDER BY created_at, model_id))
    SELECT model_id, dataset, version::INTEGER AS version, parent_model_id, 'development' AS stage FROM v
    WHERE created_at >= TIMESTAMP '1998-01-01'""",
)
def register_versions(spark, d):
    rows = models(spark, d).drop("version")
    early = rows.where("created_at < timestamp_ntz'1998-01-01'")
    none = models(spark, d).where(F.lit(False))
    stored = R.register(none, early)
    out = R.register(stored, rows.where("created_at >= timestamp_ntz'1998-01-01'"))
    return out.select("model_id", "dataset", "version", "parent_model_id", "stage")


@query(
    "list_models",
    f"WITH {MODELS} SELECT model_id, dataset, stage, created_at FROM m WHERE dataset = '1-URGENT' "
    "ORDER BY created_at DESC, model_id DESC LIMIT 100",
)
def list_models(spark, d):
    return R.list_models(models(spark, d), "1-URGENT", 100).select("model_id", "dataset", "stage", "created_at")


@query(
    "model_lineage",
    f"WITH {MODELS} SELECT model_id, run_id, dataset, model_type, stage, created_at FROM m "
    "ORDER BY created_at DESC, model_id DESC LIMIT 200",
)
def model_lineage(spark, d):
    return R.model_lineage(models(spark, d)).drop("version", "metrics")


@query(
    "latest_production",
    f"""WITH {MODELS} SELECT model_id, dataset, created_at FROM m WHERE stage = 'production'
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY created_at DESC, model_id DESC) = 1""",
)
def latest_production(spark, d):
    return R.latest_production(models(spark, d)).select("model_id", "dataset", "created_at")


@query(
    "recent_production",
    f"""WITH {MODELS} SELECT model_id, dataset, created_at FROM m WHERE stage = 'production'
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY created_at DESC, model_id DESC) <= 2""",
)
def recent_production(spark, d):
    return R.recent_production(models(spark, d), 2).select("model_id", "dataset", "created_at")


@query("stage_counts", f"WITH {MODELS} SELECT dataset, stage, count(*) AS models FROM m GROUP BY ALL")
def stage_counts(spark, d):
    return P.stage_counts(models(spark, d), by=["dataset"])


@query(
    "stage_board",
    f"""WITH {MODELS} SELECT dataset, count(*) FILTER (stage = 'development') AS development,
      count(*) FILTER (stage = 'staging') AS staging, count(*) FILTER (stage = 'production') AS production,
      0::BIGINT AS archived FROM m GROUP BY dataset""",
)
def stage_board(spark, d):
    return P.stage_board(models(spark, d), ["dataset"])


# Stage requests -----------------------------------------------------------------------------------------------


def requests_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    stage = (
        F.when(kind == "purchase", "production")
        .when(kind == "click", "development")
        .when(kind == "error", "archived")
        .otherwise("staging")
    )
    return events.select(
        (F.col("user_id") % 10).cast("string").alias("dataset"),
        F.col("user_id").cast("string").alias("model_id"),
        stage.alias("to_stage"),
        F.col("ts").alias("changed_at"),
        "event_id",
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    return requests_of(table(spark, d, "events"))


REQUESTS = """
    req AS (SELECT (user_id % 10)::VARCHAR AS dataset, user_id::VARCHAR AS model_id,
                   CASE event_type WHEN 'purchase' THEN 'production' WHEN 'click' THEN 'development'
                                   WHEN 'error' THEN 'archived' ELSE 'staging' END AS to_stage,
                   ts AS changed_at, event_id FROM events)"""
LOG = f"""{REQUESTS},
    a AS (SELECT *, last_value(CASE WHEN to_stage = 'production' THEN model_id END IGNORE NULLS) OVER (
            PARTITION BY dataset ORDER BY changed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp
          FROM req),
    b AS (SELECT *, CASE WHEN to_stage = 'production' THEN model_id WHEN lp = model_id THEN '' END AS mark FROM a),
    c AS (SELECT *, nullif(last_value(mark IGNORE NULLS) OVER (
            PARTITION BY dataset ORDER BY changed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
            AS holder FROM b),
    steps AS (
      SELECT dataset, changed_at, event_id, 1 AS ord, model_id, to_stage, 'manual stage update' AS note FROM c
      UNION ALL
      SELECT dataset, changed_at, event_id, 0, holder, 'staging', 'auto-demoted while promoting ' || model_id
      FROM c WHERE to_stage = 'production' AND holder IS NOT NULL AND holder <> model_id),
    all_steps AS (
      SELECT *, coalesce(lag(to_stage) OVER (PARTITION BY dataset, model_id ORDER BY changed_at, event_id, ord),
                         'development') AS from_stage FROM steps),
    log AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY changed_at, event_id, ord) AS seq
            FROM all_steps WHERE from_stage <> to_stage)"""


@query(
    "apply_transitions",
    f"WITH {LOG} SELECT dataset, model_id, from_stage, to_stage, changed_at, event_id, ord, note FROM log",
)
def apply_transitions(spark, d):
    return R.apply_transitions(requests(spark, d))


@query(
    "current_stage",
    f"WITH {LOG} SELECT dataset, model_id, arg_max(to_stage, seq) AS stage FROM log GROUP BY ALL",
)
def current_stage(spark, d):
    return R.current_stage(R.apply_transitions(requests(spark, d)))


@query(
    "rollback_hint",
    f"""WITH {LOG},
    pm AS (SELECT dataset, model_id, max(seq) FILTER (to_stage = 'production') AS promoted, arg_max(to_stage, seq) AS stage
           FROM log GROUP BY ALL),
    two AS (SELECT * FROM pm WHERE promoted IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY promoted DESC) <= 2)
    SELECT dataset, max(model_id) FILTER (stage = 'production') AS current_production,
           arg_max(model_id, promoted) FILTER (stage <> 'production') AS previous_production
    FROM two GROUP BY dataset""",
)
def rollback_hint(spark, d):
    return R.rollback_hint(R.apply_transitions(requests(spark, d)))


@query(
    "stage_timeline",
    f"""WITH {REQUESTS}, t AS (
      SELECT *, row_number() OVER w AS position, lead(to_stage) OVER w AS from_stage FROM req
      WINDOW w AS (PARTITION BY model_id ORDER BY changed_at DESC, event_id DESC))
    SELECT model_id, position::INTEGER AS position, from_stage, to_stage, event_id FROM t WHERE position <= 5""",
)
def stage_timeline(spark, d):
    out = R.stage_timeline(requests(spark, d), n=5)
    return out.select("model_id", "position", "from_stage", "to_stage", "event_id")


@query(
    "initial_events",
    f"""WITH {MODELS}, e AS (SELECT DISTINCT 'M' || l_orderkey AS model_id FROM lineitem)
    SELECT model_id, dataset, 'development' AS to_stage, created_at AS changed_at, 'initial registration' AS note
    FROM m WHERE model_id NOT IN (SELECT model_id FROM e)""",
)
def initial_events(spark, d):
    events = table(spark, d, "lineitem").select(F.concat(F.lit("M"), F.col("l_orderkey").cast("string")).alias("model_id"))
    return R.initial_events(models(spark, d), events).drop("from_stage")


@query(
    "audit_trail",
    f"""WITH {MODELS} SELECT name AS model, 1 AS version, dataset, l_linestatus AS from_stage, l_returnflag AS to_stage,
      l_shipdate AS changed_at, l_linenumber::VARCHAR AS note FROM m JOIN lineitem ON model_id = 'M' || l_orderkey""",
)
def audit_trail(spark, d):
    events = table(spark, d, "lineitem").select(
        F.concat(F.lit("M"), F.col("l_orderkey").cast("string")).alias("model_id"),
        F.lit("").alias("dataset"),
        F.col("l_linestatus").alias("from_stage"),
        F.col("l_returnflag").alias("to_stage"),
        F.col("l_shipdate").alias("changed_at"),
        F.col("l_linenumber").cast("string").alias("note"),
    )
    return R.audit_trail(models(spark, d), events)


@query(
    "compliance",
    f"""WITH {MODELS} SELECT model_id, name, 1 AS version, dataset, accuracy, f1_score,
      CASE WHEN accuracy >= 0.80 AND f1_score >= 0.75 THEN 'compliant' ELSE 'non_compliant' END AS status
    FROM m WHERE stage = 'production'""",
)
def compliance(spark, d):
    return R.compliance(models(spark, d))


# Keyed tables -------------------------------------------------------------------------------------------------


@query(
    "upsert_latest",
    """WITH o AS (SELECT o_custkey AS id, o_totalprice AS value, o_orderdate AS at, o_orderkey AS seq FROM orders
                  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT coalesce(c_custkey, o.id) AS id, coalesce(o.value, c_acctbal) AS value, coalesce(c_mktsegment, 'NEW') AS stage,
           coalesce(o.at, TIMESTAMP '1990-01-01') AS at, coalesce(o.seq, -1) AS seq
    FROM customer FULL JOIN o ON c_custkey = o.id""",
)
def upsert_latest(spark, d):
    current = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("value"),
        F.col("c_mktsegment").alias("stage"),
        F.expr("timestamp_ntz'1990-01-01'").alias("at"),
        F.lit(-1).cast("bigint").alias("seq"),
    )
    changes = table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_totalprice").alias("value"),
        F.lit("NEW").alias("stage"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderkey").alias("seq"),
    )
    return R.upsert(current, changes, ["id"], ["at", "seq"], keep_cols=["stage"])


@query(
    "upsert_events",
    """SELECT user_id, event_type, value, ts, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def upsert_events(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    old = R.top_per_group(ev.where("ts < timestamp_ntz'2024-01-15'"), ["user_id"], ["ts", "event_id"], 1)
    return R.upsert(old, ev.where("ts >= timestamp_ntz'2024-01-15'"), ["user_id"], ["ts", "event_id"])


@query(
    "insert_new",
    """WITH cur AS (SELECT c_custkey AS id, c_name AS name, 'stored' AS origin FROM customer WHERE c_nationkey < 10),
    new AS (SELECT o_custkey AS id, max_by(o_orderkey, (o_orderdate, o_orderkey))::VARCHAR AS name FROM orders GROUP BY 1)
    SELECT * FROM cur UNION ALL SELECT id, name, 'new' FROM new WHERE id NOT IN (SELECT id FROM cur)""",
)
def insert_new(spark, d):
    cust = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    current = cust.where("c_nationkey < 10").select("id", "name", F.lit("stored").alias("origin"))
    new = table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("name"), F.lit("new").alias("origin"),
        "o_orderdate", "o_orderkey",
    )
    return R.insert_new(current, new, ["id"], ["o_orderdate", "o_orderkey"])


@query(
    "unique_violations",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def unique_violations(spark, d):
    return R.unique_violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "orphans",
    """SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def orphans(spark, d):
    parents = table(spark, d, "customer").where("c_acctbal > 0")
    return R.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", "c_custkey")


# Experiments --------------------------------------------------------------------------------------------------


def experiments(spark: SparkSession, d: str) -> DataFrame:
    """events as runs: the JSON property is the metric, the value the duration."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("run_id"),
        (F.col("user_id") % 10).cast("string").alias("dataset"),
        F.col("event_type").alias("model_type"),
        F.to_json(F.struct((k / 100.0).alias("accuracy"), F.array(k, k).alias("roc_curve_fpr"))).alias("metrics"),
        F.col("value").alias("duration_seconds"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") != "view", "completed").alias("status"),
        F.col("ts").alias("created_at"),
    )


EXPERIMENTS = """
    x AS (SELECT event_id::VARCHAR AS run_id, (user_id % 10)::VARCHAR AS dataset, event_type AS algorithm,
                 CAST(json_extract(props, '$.k') AS DOUBLE) / 100.0 AS accuracy, round(value, 2) AS duration,
                 ts AS created_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN NULL ELSE 'completed' END AS status
          FROM events)"""


@query(
    "experiment_grid",
    f"""WITH {EXPERIMENTS} SELECT run_id, dataset, algorithm, accuracy, NULL::DOUBLE AS f1_score, duration, created_at,
      coalesce(status, 'completed') AS status FROM x""",
)
def experiment_grid(spark, d):
    return R.experiment_grid(experiments(spark, d))


@query(
    "experiment_kpis",
    f"""WITH {EXPERIMENTS} SELECT dataset, count(*) AS runs, max(accuracy) AS best_accuracy,
      round(avg(duration), 4) AS avg_duration,
      round(avg((coalesce(status, '') = 'completed')::INTEGER) * 100, 6) AS success_pct,
      trunc(avg((coalesce(status, '') = 'completed')::INTEGER) * 50 + least(max(accuracy) * 100, 100) * 0.5::DOUBLE)::INTEGER
        AS platform_score
    FROM x GROUP BY dataset""",
)
def experiment_kpis(spark, d):
    out = P.experiment_kpis(experiments(spark, d), by=["dataset"])
    return out.withColumns({"avg_duration": F.round("avg_duration", 4), "success_pct": F.round("success_pct", 6)})


@query(
    "list_experiments",
    f"WITH {EXPERIMENTS} SELECT run_id, dataset, created_at FROM x ORDER BY created_at DESC, run_id DESC LIMIT 100",
)
def list_experiments(spark, d):
    return R.list_experiments(experiments(spark, d), 100).select("run_id", "dataset", "created_at")


@query(
    "activity_feed",
    f"""WITH {EXPERIMENTS} SELECT strftime(created_at, '%H:%M') AS time, algorithm || ' on ' || dataset AS label, status
    FROM x ORDER BY created_at DESC, run_id DESC LIMIT 6""",
)
def activity_feed(spark, d):
    return P.activity_feed(experiments(spark, d))


@query("duration_series", "SELECT ts, value AS duration_seconds FROM events")
def duration_series(spark, d):
    return P.duration_series(experiments(spark, d))


# Data-set versions and lineage --------------------------------------------------------------------------------


def _hash_sql(name: str, cols: list[str], by: str = "") -> str:
    text = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-1:')" for c in cols)
    names = "".join(f"{len(c)}:{c}" for c in cols)
    k = f"{by}, " if by else ""
    zeros = ",".join(f'"{c}":0' for c in cols)
    return f"""SELECT {k}'{name}' AS dataset_id,
      md5(concat_ws('|', '{names}', count(*)::VARCHAR,
        sum(('0x' || substr(md5({text}), 1, 12))::BIGINT)::HUGEINT::VARCHAR)) AS hash,
      count(*) AS row_count, {len(cols)} AS column_count, '{{{zeros}}}' AS missing_values_summary
    FROM {name} GROUP BY ALL"""


@query(
    "dataset_version",
    _hash_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"], "o_orderpriority"),
)
def dataset_version(spark, d):
    return L.dataset_version(table(spark, d, "orders"), "orders", by=["o_orderpriority"])


@query(
    "schema_change",
    """WITH s AS (SELECT user_id::VARCHAR AS dataset_id, event_type AS column_name,
                         CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 0 ELSE 1 END AS later,
                         CASE WHEN max(value) >= 100 THEN 'int' ELSE 'tinyint' END AS dtype
                  FROM events GROUP BY ALL),
    j AS (SELECT coalesce(a.dataset_id, b.dataset_id) AS dataset_id, coalesce(a.column_name, b.column_name) AS c,
                 a.dtype AS old_type, b.dtype AS new_type
          FROM (SELECT * FROM s WHERE later = 0) a FULL JOIN (SELECT * FROM s WHERE later = 1) b
          ON a.dataset_id = b.dataset_id AND a.column_name = b.column_name)
    SELECT dataset_id, coalesce(string_agg(c, ',' ORDER BY c) FILTER (old_type IS NULL), '') AS added_columns,
           coalesce(string_agg(c, ',' ORDER BY c) FILTER (new_type IS NULL), '') AS removed_columns,
           coalesce(string_agg(c || ':' || old_type || '->' || new_type, ',' ORDER BY c) FILTER (old_type <> new_type), '')
             AS dtype_changes
    FROM j GROUP BY dataset_id""",
)
def schema_change(spark, d):
    """Users as data sets and event types as columns whose type is inferred from the largest value seen."""
    ev = table(spark, d, "events")
    later = F.col("ts") >= F.expr("timestamp_ntz'2024-01-08'")
    snap = ev.groupBy(
        F.col("user_id").cast("string").alias("dataset_id"), F.col("event_type").alias("column_name"), later.alias("later")
    ).agg(F.when(F.max("value") >= 100, "int").otherwise("tinyint").alias("dtype"))
    out = L.schema_change(snap.where("NOT later"), snap.where("later"), keys=["dataset_id"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("added_columns", "removed_columns", "dtype_changes")})


@query(
    "dataset_versions",
    """SELECT o_orderkey AS version, o_totalprice AS row_count FROM orders WHERE o_orderpriority = '2-HIGH'
    ORDER BY o_orderkey DESC LIMIT 50""",
)
def dataset_versions(spark, d):
    t = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("dataset_id"),
        F.col("o_orderkey").alias("version"),
        F.col("o_totalprice").alias("row_count"),
    )
    return L.versions(t, "2-HIGH").drop("dataset_id")


@query(
    "edges",
    """SELECT o_orderkey AS id, o_orderdate AS created_at, o_custkey AS from_dataset_id FROM orders
    WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""",
)
def edges(spark, d):
    t = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "train").otherwise("transform").alias("edge_type"),
        F.col("o_custkey").alias("from_dataset_id"),
        F.col("o_orderdate").alias("created_at"),
    )
    return L.edges(t, "train").drop("edge_type")


# Prediction log -----------------------------------------------------------------------------------------------


def prediction_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    conv = table(spark, d, "conversations")
    reqs = conv.groupBy(F.col("conv_id").alias("request_id")).agg(F.count("*").alias("num_predictions"))
    preds = conv.select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("row_index"),
        F.col("role").alias("prediction"),
        F.length("text").cast("string").alias("probability"),
    )
    return reqs, preds


@query(
    "request_detail",
    """SELECT conv_id AS request_id, count(*) OVER (PARTITION BY conv_id) AS num_predictions, turn AS row_index,
      role AS prediction, length(text)::VARCHAR AS probability FROM conversations""",
)
def request_detail(spark, d):
    reqs, preds = prediction_log(spark, d)
    return H.request_detail(reqs, preds)


@query(
    "request_pages",
    """SELECT conv_id AS request_id, turn // 2 AS page, string_agg(turn || ':' || role, ',' ORDER BY turn) AS predictions
    FROM conversations GROUP BY ALL""",
)
def request_pages(spark, d):
    reqs, preds = prediction_log(spark, d)
    out = H.request_pages(reqs.select("request_id"), preds, page_size=2, fields=("prediction",))
    text = F.transform("predictions", lambda p: F.concat_ws(":", p.row_index.cast("string"), p.prediction))
    return out.withColumn("predictions", F.array_join(text, ","))


@query(
    "prediction_history",
    """SELECT event_id::VARCHAR AS request_id, user_id::VARCHAR AS model_id, ts AS created_at FROM events
    ORDER BY ts DESC, request_id DESC LIMIT 200""",
)
def prediction_history(spark, d):
    reqs = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("user_id").cast("string").alias("model_id"),
        F.col("ts").alias("created_at"),
    )
    return H.history(reqs, n=200)


@query(
    "prediction_rows",
    """SELECT vec_id AS request_id, (pos - 1)::INTEGER AS row_index, (v * 1000)::INTEGER::VARCHAR AS prediction,
      (pos - 1)::VARCHAR AS probability
    FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""",
)
def prediction_rows(spark, d):
    emb = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("request_id"),
        F.transform("embedding", lambda v: F.rint((v * F.lit(1000).cast("float")).cast("double")).cast("int")).alias("predictions"),
        F.transform("embedding", lambda v, i: i).alias("probabilities"),
    )
    return H.prediction_rows(emb, "predictions", "probabilities")


# Governance ---------------------------------------------------------------------------------------------------


@query(
    "activity_counts",
    """SELECT user_id, event_type AS action, count(*) AS actions, max(ts) AS last_at FROM events GROUP BY ALL""",
)
def activity_counts(spark, d):
    acts = table(spark, d, "events").select("user_id", F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    return G.activity_counts(acts)


@query(
    "activity_pages",
    """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS page, count(*) AS n FROM events GROUP BY ALL""",
)
def activity_pages(spark, d):
    acts = table(spark, d, "events").withColumnRenamed("props", "metadata_json")
    out = G.activity_field(acts, "k")
    return out.groupBy(F.col("k").cast("bigint").alias("page")).agg(F.count("*").alias("n"))


@query(
    "alert_events",
    """SELECT event_id AS id, ts AS created_at, value FROM events WHERE user_id % 3 = 1
    ORDER BY ts DESC, event_id DESC LIMIT 300""",
)
def alert_events(spark, d):
    t = table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("workspace_id"), F.col("ts").alias("created_at"), "value"
    )
    return G.alerts(t, workspace=1, n=300).drop("workspace_id")


@query(
    "due_schedules",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'
      AND (o_custkey % 7 IN (0, 1) OR o_orderdate <= TIMESTAMP '1997-06-01')""",
)
def due_schedules(spark, d):
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("o_custkey") % 7 == 1, "soon").when(F.col("o_custkey") % 7 != 0, at)
    t = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("enabled"), text.alias("next_run_at")
    )
    return G.due_schedules(t, F.lit("1997-06-01 00:00:00").cast("timestamp")).select("id")


@query(
    "schedule_status",
    """SELECT user_id AS schedule_id, count(*) AS runs, arg_max(s, (ts, s)) AS last_status,
      round(avg((s = 'success')::INTEGER) * 100, 6) AS success_pct
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END AS s FROM events)
    GROUP BY user_id""",
)
def schedule_status(spark, d):
    s = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("success")
    t = table(spark, d, "events").select(
        F.col("user_id").alias("schedule_id"), s.alias("status"), F.col("ts").alias("started_at")
    )
    return G.schedule_status(t).withColumn("success_pct", F.round("success_pct", 6))


@query(
    "schema_rows",
    """SELECT 'V1' AS dataset_version_id, column_name, CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int'
      WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'DATE' THEN 'date'
      WHEN data_type = 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS dtype
    FROM (DESCRIBE SELECT * FROM orders) t(column_name, data_type, a, b, c, e)""",
)
def schema_rows(spark, d):
    return L.schema_snapshot(table(spark, d, "orders"), "V1")


@query("load_by_name", "SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1")
def load_by_name(spark, d):
    nation = load(spark, d, "nation", catalog=["nation", "region"])
    return nation.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("n_name").alias("last"))
