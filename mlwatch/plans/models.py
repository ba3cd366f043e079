"""Split, evaluation and training queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.operators import evaluate as E
from mlwatch.operators import profile as P
from mlwatch.operators import split as S
from mlwatch.operators import train as T
from mlwatch.operators.frames import shared_dir
from mlwatch.plans.register import query, table
from mlwatch.sources.tables import cached_split

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_RANKED = """
    k AS (SELECT *, md5(concat_ws('|', '42', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR,
                                  l_suppkey::VARCHAR)) AS dig FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY dig) AS rk FROM k)"""
_SPLIT = f"""{_RANKED},
    sz AS (SELECT l_returnflag AS grp, count(*) AS n FROM lineitem GROUP BY 1),
    tot AS (SELECT sum(n) AS total, sum(n) - ceil(0.2::DOUBLE * sum(n)) AS n_train FROM sz),
    fl AS (SELECT grp, n, n_train, floor(n / total * n_train) AS base,
                  n / total * n_train - floor(n / total * n_train) AS rest FROM sz, tot),
    al AS (SELECT grp, n - (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, grp) <= n_train - sum(base) OVER ()
                                        THEN 1 ELSE 0 END) AS quota FROM fl),
    sp AS (SELECT r.*, CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split
           FROM r JOIN al ON r.l_returnflag = al.grp)"""


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*KEYS, *NUMS, "l_returnflag", "l_linestatus")


@query(
    "split",
    f"""WITH {_SPLIT}
    SELECT split, l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS orders, sum(l_partkey)::BIGINT AS parts
    FROM sp GROUP BY ALL""",
)
def split(spark, d):
    out = S.split(lineitem(spark, d), KEYS, 0.2, 42, "l_returnflag")
    return out.groupBy("split", "l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"), F.sum("l_partkey").alias("parts")
    )


@query(
    "split_rows",
    """WITH k AS (SELECT vec_id, md5(concat_ws('|', '7', vec_id::VARCHAR)) AS dig FROM embeddings),
    r AS (SELECT *, row_number() OVER (ORDER BY dig) AS rk, count(*) OVER () AS n FROM k)
    SELECT vec_id, CASE WHEN rk <= n - (n - ceil(0.3::DOUBLE * n)) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def split_rows(spark, d):
    return S.split(table(spark, d, "embeddings").select("vec_id"), ["vec_id"], 0.3, 7)


@query(
    "kfold",
    f"""WITH {_RANKED},
    sz AS (SELECT l_returnflag AS grp, count(*) AS n FROM lineitem GROUP BY 1),
    st AS (SELECT grp, n, sum(n) OVER (ORDER BY grp) - n AS s FROM sz),
    q AS (SELECT grp, i, sum(floor((s + n - 1 - i) / 5) - floor((s - 1 - i) / 5))
                   OVER (PARTITION BY grp ORDER BY i) AS upto
          FROM st, range(0, 5) t(i)),
    f AS (SELECT r.l_orderkey, r.l_partkey, r.l_returnflag, r.rk,
                 (SELECT count(*) FROM q WHERE q.grp = r.l_returnflag AND i < 4 AND q.upto < r.rk)::INTEGER AS fold
          FROM r)
    SELECT fold, l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS orders, sum(l_partkey)::BIGINT AS parts
    FROM f GROUP BY ALL""",
)
def kfold(spark, d):
    out = S.kfold(lineitem(spark, d), KEYS, 5, 42, "l_returnflag")
    return out.groupBy("fold", "l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"), F.sum("l_partkey").alias("parts")
    )


@query(
    "split_summary",
    f"""WITH {_SPLIT},
    per_class AS (SELECT split, l_returnflag, count(*) AS k, count(*) FILTER (l_tax = 0) AS gaps FROM sp GROUP BY ALL),
    per_split AS (SELECT split, sum(k)::BIGINT AS rows, sum(gaps)::BIGINT AS missing_values FROM per_class GROUP BY split)
    SELECT split, rows, 4::BIGINT AS features, missing_values,
           string_agg(printf('%s=%.4f', l_returnflag, k / rows), ', ' ORDER BY l_returnflag) AS class_shares
    FROM per_class JOIN per_split USING (split) GROUP BY ALL""",
)
def split_summary(spark, d):
    li = lineitem(spark, d).withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0)))
    out = S.split(li, KEYS, 0.2, 42, "l_returnflag")
    return P.split_summary(out.select(*NUMS, "l_returnflag", "split"), "split", "l_returnflag")


@query(
    "standardize",
    f"""WITH {_SPLIT},
    m AS (SELECT avg(l_tax) AS m1, stddev_pop(l_tax) AS s1, avg(l_quantity) AS m2, stddev_pop(l_quantity) AS s2
          FROM sp WHERE split = 'train')
    SELECT split, round(avg((l_tax - m1) / s1), 6) + 0.0 AS tax_mean, round(stddev_pop((l_tax - m1) / s1), 6) AS tax_std,
           round(max((l_quantity - m2) / s2), 6) AS quantity_max
    FROM sp, m GROUP BY split""",
)
def standardize(spark, d):
    out = S.split(lineitem(spark, d), KEYS, 0.2, 42, "l_returnflag")
    z = S.standardize(out, ["l_tax", "l_quantity"], fit_on=F.col("split") == "train")
    return z.groupBy("split").agg(
        (F.round(F.avg("l_tax"), 6) + 0.0).alias("tax_mean"),
        F.round(F.stddev_pop("l_tax"), 6).alias("tax_std"),
        F.round(F.max("l_quantity"), 6).alias("quantity_max"),
    )


_PRED = "SELECT quality AS y, 1 - toxic AS p FROM labels"


@query(
    "confusion",
    f"""WITH x AS ({_PRED}), l AS (SELECT DISTINCT y AS c FROM x UNION SELECT p FROM x)
    SELECT a.c AS label, b.c AS pred, (SELECT count(*) FROM x WHERE x.y = a.c AND x.p = b.c) AS n FROM l a, l b""",
)
def confusion(spark, d):
    x = table(spark, d, "labels").select(F.col("quality").alias("y"), (1 - F.col("toxic")).alias("p"))
    return E.confusion(x, "y", "p")


@query(
    "confusion_wide",
    """SELECT l_returnflag AS label, count(*) FILTER (l_linestatus = 'O') AS pred_O,
           count(*) FILTER (l_linestatus = 'F') AS pred_F FROM lineitem GROUP BY 1""",
)
def confusion_wide(spark, d):
    return E.confusion_matrix(lineitem(spark, d), "l_returnflag", "l_linestatus", ["O", "F"])


def class_sql(src: str) -> str:
    return f"""WITH x AS ({src}), l AS (SELECT DISTINCT y AS c FROM x UNION SELECT p FROM x),
    m AS (SELECT c, (SELECT count(*) FROM x WHERE y = c) AS s, (SELECT count(*) FROM x WHERE p = c) AS q,
                 (SELECT count(*) FROM x WHERE y = c AND p = c) AS tp FROM l),
    z AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS re,
                 2 * tp / (s + q) AS f FROM m)
    SELECT round(sum(tp) / sum(s), 4) AS accuracy, round(sum(pr * s) / sum(s), 4) AS precision,
           round(sum(re * s) / sum(s), 4) AS recall, round(sum(f * s) / sum(s), 4) AS f1_score FROM z"""


@query("class_metrics", class_sql(_PRED))
def class_metrics(spark, d):
    x = table(spark, d, "labels").select(F.col("quality").alias("y"), (1 - F.col("toxic")).alias("p"))
    return E.classification_metrics(x, "y", "p")


@query(
    "class_metrics_lineitem",
    class_sql(
        "SELECT l_returnflag AS y, CASE WHEN l_discount > 0.06 THEN 'R' WHEN l_tax > 0.04 THEN 'A' ELSE 'N' END AS p FROM lineitem"
    ),
)
def class_metrics_lineitem(spark, d):
    guess = F.when(F.col("l_discount") > 0.06, "R").when(F.col("l_tax") > 0.04, "A").otherwise("N")
    return E.classification_metrics(lineitem(spark, d).withColumn("p", guess), "l_returnflag", "p")


def auc_sql(src: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""WITH x AS ({src}), g AS (
      SELECT {k}s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM x GROUP BY ALL),
    c AS (SELECT *, sum(neg) OVER ({part}ORDER BY s) - neg AS below FROM g)
    SELECT {k}round(sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS roc_auc FROM c GROUP BY ALL"""


@query("roc_auc", auc_sql("SELECT l_returnflag = 'R' AS y, l_discount AS s FROM lineitem"))
def roc_auc(spark, d):
    li = lineitem(spark, d).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return E.roc_auc(li, "y", "l_discount").withColumn("roc_auc", F.round("roc_auc", 6))


@query(
    "roc_auc_documents",
    auc_sql(
        "SELECT d.lang, l.quality = 1 AS y, d.n_chars::DOUBLE AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
        "lang",
    ),
)
def roc_auc_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    x = table(spark, d, "labels").join(docs, "doc_id")
    return E.roc_auc(x, "quality", "n_chars", by=["lang"]).withColumn("roc_auc", F.round("roc_auc", 6))


_CURVE = """
    g AS (SELECT s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM x GROUP BY s),
    c AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
                 sum(pos) OVER () AS p, sum(neg) OVER () AS n, lag(pos) OVER (ORDER BY s) AS lp,
                 lag(neg) OVER (ORDER BY s) AS ln, max(s) OVER () AS top FROM g)"""


@query(
    "roc_curve",
    f"""WITH x AS (SELECT l_returnflag = 'R' AS y, l_discount AS s FROM lineitem), {_CURVE}
    SELECT s AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c
    UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""",
)
def roc_curve(spark, d):
    li = lineitem(spark, d).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return E.roc_curve(li, "y", "l_discount")


@query(
    "roc_curve_corners",
    f"""WITH x AS (SELECT l_returnflag = 'R' AS y, l_extendedprice AS s FROM lineitem), {_CURVE}
    SELECT s AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c
    WHERE s = top OR lp IS NULL OR lp <> pos OR ln <> neg
    UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""",
)
def roc_curve_corners(spark, d):
    li = lineitem(spark, d).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return E.roc_curve(li, "y", "l_extendedprice", drop_intermediate=True)


@query(
    "roc_auc_ovr",
    """WITH x AS (
      SELECT c, l_returnflag = c AS y, CASE c WHEN 'A' THEN l_discount WHEN 'N' THEN l_tax ELSE l_quantity END AS s
      FROM lineitem, (VALUES ('A'), ('N'), ('R')) t(c)),
    g AS (SELECT c, s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM x GROUP BY ALL),
    w AS (SELECT *, sum(neg) OVER (PARTITION BY c ORDER BY s) - neg AS below FROM g),
    a AS (SELECT c, sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM w GROUP BY c)
    SELECT round(avg(auc), 6) AS roc_auc FROM a""",
)
def roc_auc_ovr(spark, d):
    probs = {"A": "l_discount", "N": "l_tax", "R": "l_quantity"}
    return E.roc_auc_ovr(lineitem(spark, d), "l_returnflag", probs).withColumn("roc_auc", F.round("roc_auc", 6))


@query(
    "regression_metrics",
    """SELECT l_returnflag, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse, round(avg(abs(y - f)), 4) AS mae,
           round(1 - avg((y - f) * (y - f)) / var_pop(y), 4) AS r2
    FROM (SELECT l_returnflag, l_extendedprice AS y, 1500 * l_quantity AS f FROM lineitem) GROUP BY l_returnflag""",
)
def regression_metrics(spark, d):
    li = lineitem(spark, d).withColumn("f", F.col("l_quantity") * 1500)
    return E.regression_metrics(li, "l_extendedprice", "f", by=["l_returnflag"])


_SCORED = """l_orderkey, l_linenumber, l_partkey, l_suppkey, 'RUN1' AS model_id, 'lineitem' AS dataset, 1 AS version,
      'production' AS stage, true AS known_class, 1.0 AS total_probability"""


def _checked(scored: DataFrame) -> DataFrame:
    """What can be said of any classifier's scores: whose they are, a known class, probabilities that add up to one."""
    total = F.round(F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p), 6)
    return scored.withColumns({"known_class": F.col("predicted").isin("A", "N", "R"), "total_probability": total}).drop(
        "predicted", "probabilities"
    )


@query("train_score", f"WITH {_SPLIT} SELECT {_SCORED} FROM sp WHERE split = 'test'")
def train_score(spark, d):
    """Fit on the training part of lineitem and score its test part."""
    li = S.split(lineitem(spark, d), KEYS, 0.2, 42, "l_returnflag")
    m = T.fit(li.where("split = 'train'"), NUMS, "l_returnflag", "Decision Tree", params={"max_depth": 4})
    m.meta = {"model_id": "RUN1", "dataset": "lineitem", "version": 1, "stage": "production"}
    return _checked(T.score(li.where("split = 'test'"), m, keep=KEYS))


@query("production_scores", f"WITH {_SPLIT} SELECT {_SCORED} FROM sp WHERE split = 'test'")
def production_scores(spark, d):
    """As ``train_score``, with the model stored, registered, found as the newest production one and loaded."""
    li = S.split(lineitem(spark, d), KEYS, 0.2, 42, "l_returnflag")
    m = T.fit(li.where("split = 'train'"), NUMS, "l_returnflag", "Logistic Regression", params={"max_iter": 5})
    path = T.save_model(m, f"{shared_dir(spark)}/models/{uuid.uuid4().hex}")
    row = spark.range(1).select(
        F.lit("RUN1").alias("model_id"), F.lit("lineitem").alias("dataset"), F.lit(1).alias("version"),
        F.lit("production").alias("stage"), F.current_timestamp().alias("created_at"), F.lit(path).alias("artifact_path"),
    )
    older = row.withColumns({"model_id": F.lit("RUN0"), "version": F.lit(0), "artifact_path": F.lit("gone"),
                             "created_at": F.col("created_at") - F.expr("INTERVAL 1 DAY")})
    return _checked(T.score_production(li.where("split = 'test'"), row.unionByName(older), "lineitem", keep=KEYS))


@query(
    "train_ridge",
    """WITH o AS (SELECT o_orderkey, o_totalprice AS y, o_custkey::DOUBLE AS c, month(o_orderdate)::DOUBLE AS m FROM orders),
    s AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(c) AS mc, stddev_pop(c) AS sc, avg(m) AS mm, stddev_pop(m) AS sm FROM o),
    z AS (SELECT o_orderkey, y - my AS y, (c - mc) / sc AS c, (m - mm) / sm AS m, n, my FROM o, s),
    x AS (SELECT sum(c * c) + 50.0 AS cc, sum(m * m) + 50.0 AS mm, sum(c * m) AS cm, sum(c * y) AS cy, sum(m * y) AS my FROM z),
    w AS (SELECT (mm * cy - cm * my) / (cc * mm - cm * cm) AS wc, (cc * my - cm * cy) / (cc * mm - cm * cm) AS wm FROM x)
    SELECT o_orderkey, round(z.my + wc * c + wm * m, 1) AS predicted FROM z, w""",
)
def train_ridge(spark, d):
    """Predictions of a ridge regression against its normal equations."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("cust"), F.month("o_orderdate").alias("month")
    )
    m = T.fit(orders, ["cust", "month"], "o_totalprice", "Ridge Regression", "regression", {"alpha": 50.0})
    return T.score(orders, m, ["o_orderkey"]).select("o_orderkey", F.round("predicted", 1).alias("predicted"))


@query(
    "split_cache",
    f"""WITH {_SPLIT}
    SELECT split, l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS orders FROM sp GROUP BY ALL""",
)
def split_cache(spark, d):
    """A split stored once and read again."""
    root = f"{shared_dir(spark)}/splits/{uuid.uuid4().hex}"
    for _ in range(2):
        out = cached_split(lineitem(spark, d), "lineitem", KEYS, root, 0.2, 42, "l_returnflag")
    return out.groupBy("split", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


@query("train_metrics")
def train_metrics(spark, d):
    """Cross-validated linear regression on orders, as the experiment row it leaves."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("cust"), F.month("o_orderdate").alias("month")
    )
    parts = S.split(orders, ["o_orderkey"], 0.2, 42)
    run = T.train_run(
        "RUN1", "orders", parts, ["o_orderkey"], ["cust", "month"], "o_totalprice", "Ridge Regression", "regression", 2
    )
    exp, _ = T.run_to_rows(spark, run)
    return exp.select("run_id", "dataset", "model_type", "task", "status", "metrics")


PAYLOADS = """e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, value, event_id % 10 AS shape FROM events)"""


def payloads(spark, d):
    """Event properties as payloads: the four shapes, one of them behind many blanks, and five that are refused."""
    ev = table(spark, d, "events").select("event_id", "props", "value")
    k, v = F.get_json_object("props", "$.k"), F.col("value").cast("string")
    both = F.concat(F.lit('{"k": '), k, F.lit(', "v": '), v, F.lit("}"))
    pair = F.concat(F.lit("["), k, F.lit(", "), v, F.lit("]"))
    bodies = [
        both,
        pair,
        F.concat(F.lit("["), both, F.lit(', {"v": '), k, F.lit(', "other": "x", "k": '), k, F.lit("}]")),
        F.concat(F.lit("[ "), pair, F.lit(", ["), k, F.lit(","), k, F.lit("]]")),
        F.concat(F.repeat(F.lit(" "), F.lit(70)), both),
        F.concat(F.lit("["), k, F.lit("]")),
        F.concat(F.lit("[["), k, F.lit(", 1], ["), k, F.lit(", 1, 2]]")),
        F.concat(F.lit('[{"k": '), k, F.lit("}]")),
        F.concat(F.lit("["), k, F.lit(', "x"]')),
        F.lit("oops"),
    ]
    body = F.element_at(F.array(*bodies), (F.col("event_id") % 10).cast("int") + 1)
    return T.explode_payload(ev.withColumn("body", body), "body", ["k", "v"], keep=["event_id"])


@query(
    "payload_rows",
    f"""WITH {PAYLOADS} SELECT event_id, 0::INTEGER AS row_index, k, value AS v FROM e WHERE shape < 5
    UNION ALL SELECT event_id, 1::INTEGER, k, k FROM e WHERE shape IN (2, 3)""",
)
def payload_rows(spark, d):
    return payloads(spark, d)[0]


@query(
    "payload_rejects",
    f"""WITH {PAYLOADS} SELECT event_id, CASE shape WHEN 5 THEN 'vector length' WHEN 6 THEN 'vector length'
      WHEN 7 THEN 'missing feature' WHEN 8 THEN 'not a number' ELSE 'not JSON' END AS reason FROM e WHERE shape >= 5""",
)
def payload_rejects(spark, d):
    return payloads(spark, d)[1].select("event_id", "reason")
