"""Data-quality and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.functions.columns import align, backfill, features
from mlwatch.operators import profile as P
from mlwatch.operators import quality as Q
from mlwatch.plans.register import query, table
from mlwatch.sources.tables import preview, retain

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def holes(spark: SparkSession, d: str) -> DataFrame:
    """lineitem numbers with zero discounts and taxes as missing cells."""
    li = table(spark, d, "lineitem").select(*NUMS, "l_returnflag")
    return li.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in ("l_discount", "l_tax")})


HOLES = """SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
                  l_returnflag FROM lineitem"""


def derived(spark: SparkSession, d: str) -> DataFrame:
    """lineitem numbers with a constant, a scaled copy and a product."""
    return table(spark, d, "lineitem").select(
        *NUMS,
        F.lit(1.0).alias("one"),
        (F.col("l_extendedprice") * 2 + 7).alias("twice"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("tax_paid"),
        "l_returnflag",
    )


DERIVED = """SELECT l_quantity, l_extendedprice, l_discount, l_tax, 1.0::DOUBLE AS one,
                    l_extendedprice * 2 + 7 AS twice, l_extendedprice * l_tax AS tax_paid, l_returnflag FROM lineitem"""


@query(
    "missing_report",
    f"""WITH h AS ({HOLES}), m AS (
      SELECT 'l_discount' AS "column", count(*) FILTER (l_discount IS NULL) AS k, count(*) AS n FROM h UNION ALL
      SELECT 'l_tax', count(*) FILTER (l_tax IS NULL), count(*) FROM h UNION ALL
      SELECT 'l_quantity', count(*) FILTER (l_quantity IS NULL), count(*) FROM h UNION ALL
      SELECT 'l_extendedprice', count(*) FILTER (l_extendedprice IS NULL), count(*) FROM h UNION ALL
      SELECT 'l_returnflag', count(*) FILTER (l_returnflag IS NULL), count(*) FROM h)
    SELECT "column", k AS missing_count, round(k / n * 100, 6) AS missing_pct FROM m""",
)
def missing_report(spark, d):
    out = Q.missing_report(holes(spark, d))
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "missing_total",
    f"""WITH h AS ({HOLES})
    SELECT l_returnflag, count(*) FILTER (l_discount IS NULL) + count(*) FILTER (l_tax IS NULL) AS total_missing,
           round((count(*) FILTER (l_discount IS NULL) + count(*) FILTER (l_tax IS NULL)) / (count(*) * 4) * 100, 6)
             AS total_missing_pct
    FROM h GROUP BY ALL""",
)
def missing_total(spark, d):
    out = Q.missing_total(holes(spark, d), NUMS, by=["l_returnflag"])
    return out.withColumn("total_missing_pct", F.round("total_missing_pct", 6))


@query(
    "duplicate_report",
    """WITH g AS (SELECT count(*) AS k FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)
    SELECT sum(k) FILTER (k > 1)::BIGINT AS duplicate_rows,
           round(sum(k) FILTER (k > 1) / sum(k) * 100, 6) AS duplicate_rows_pct FROM g""",
)
def duplicate_report(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    return Q.duplicate_report(li).withColumn("duplicate_rows_pct", F.round("duplicate_rows_pct", 6))


@query(
    "duplicate_documents",
    """WITH g AS (SELECT lang, count(*) AS k FROM documents GROUP BY lang, text, source, n_chars)
    SELECT lang, coalesce(sum(k) FILTER (k > 1), 0)::BIGINT AS duplicate_rows,
           round(coalesce(sum(k) FILTER (k > 1), 0) / sum(k) * 100, 6) AS duplicate_rows_pct FROM g GROUP BY lang""",
)
def duplicate_documents(spark, d):
    docs = table(spark, d, "documents").drop("doc_id")
    out = Q.duplicate_report(docs, ["text", "source", "n_chars"], by=["lang"], two_step=True)
    return out.withColumn("duplicate_rows_pct", F.round("duplicate_rows_pct", 6))


@query(
    "constant_report",
    f"""WITH x AS ({DERIVED})
    SELECT feature FROM (SELECT * FROM x UNPIVOT (v FOR feature IN
      (l_quantity, l_extendedprice, l_discount, l_tax, one, twice, tax_paid)))
    GROUP BY feature HAVING min(v) = max(v) AND count(v) >= 2""",
)
def constant_report(spark, d):
    return Q.constant_report(derived(spark, d))


@query(
    "constant_text",
    """SELECT o_orderstatus, 'c' AS feature FROM orders GROUP BY o_orderstatus HAVING count(DISTINCT o_orderstatus) <= 1""",
)
def constant_text(spark, d):
    orders = table(spark, d, "orders").select("o_orderstatus", F.col("o_orderstatus").alias("c"), "o_orderpriority")
    return Q.constant_report(orders, ["c", "o_orderpriority"], by=["o_orderstatus"])


@query(
    "type_mismatch",
    """SELECT 'o_orderstatus' AS feature, 'string' AS dtype,
              count(*) FILTER (try_cast(o_orderstatus AS DOUBLE) IS NULL) AS non_numeric_values FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string',
              count(*) FILTER (try_cast(o_orderpriority AS DOUBLE) IS NULL) FROM orders""",
)
def type_mismatch(spark, d):
    return Q.type_mismatch_report(table(spark, d, "orders"))


@query(
    "outliers_iqr",
    """WITH q AS (
      SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n
      FROM events GROUP BY event_type),
    o AS (
      SELECT e.event_type, 'value' AS feature, any_value(n) AS n,
             count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outlier_count
      FROM events e JOIN q ON e.event_type = q.event_type GROUP BY ALL)
    SELECT event_type, feature, outlier_count, round(outlier_count / n * 100, 6) AS outlier_pct FROM o""",
)
def outliers_iqr(spark, d):
    out = Q.outlier_report(table(spark, d, "events"), ["value"], by=["event_type"])
    return out.withColumn("outlier_pct", F.round("outlier_pct", 6))


@query(
    "outliers_z",
    """WITH q AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type)
    SELECT e.event_type, 'value' AS feature, count(*) FILTER (abs(value - m) / s > 3) AS outlier_count,
           round(count(*) FILTER (abs(value - m) / s > 3) / count(*) * 100, 6) AS outlier_pct
    FROM events e JOIN q ON e.event_type = q.event_type GROUP BY ALL""",
)
def outliers_z(spark, d):
    out = Q.outlier_report(table(spark, d, "events"), ["value"], "zscore", by=["event_type"])
    return out.withColumn("outlier_pct", F.round("outlier_pct", 6))


@query(
    "range_report",
    """WITH u AS (SELECT feature, v FROM lineitem UNPIVOT (v FOR feature IN
        (l_quantity, l_extendedprice, l_discount, l_tax))),
    q AS (SELECT feature, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM u GROUP BY feature)
    SELECT u.feature, count(*) FILTER (v < lo OR v > hi) AS invalid_count,
           round(count(*) FILTER (v < lo OR v > hi) / count(*) * 100, 6) AS invalid_pct
    FROM u JOIN q ON u.feature = q.feature GROUP BY ALL""",
)
def range_report(spark, d):
    out = Q.range_report(table(spark, d, "lineitem"), NUMS)
    return out.withColumn("invalid_pct", F.round("invalid_pct", 6))


@query(
    "class_balance",
    """SELECT l_returnflag AS class, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct
    FROM lineitem GROUP BY l_returnflag""",
)
def class_balance(spark, d):
    return Q.class_balance(table(spark, d, "lineitem"), "l_returnflag").withColumn("pct", F.round("pct", 6))


@query(
    "class_summary",
    """WITH c AS (SELECT quality, toxic, count(*) AS k FROM labels GROUP BY ALL),
    t AS (SELECT *, k / sum(k) OVER (PARTITION BY quality) AS p FROM c)
    SELECT quality, count(*) AS n_classes,
           CASE WHEN count(*) >= 2 THEN round(max(k) / min(k), 6) END AS imbalance_ratio,
           round(-sum(p * log2(p)), 6) AS entropy FROM t GROUP BY quality""",
)
def class_summary(spark, d):
    out = Q.class_summary(table(spark, d, "labels"), "toxic", by=["quality"])
    return out.withColumns({c: F.round(c, 6) for c in ("imbalance_ratio", "entropy")})


@query(
    "high_corr",
    f"""WITH x AS ({DERIVED}), c AS (
      SELECT 'l_extendedprice' AS feature_a, 'twice' AS feature_b, abs(corr(l_extendedprice, twice)) AS r FROM x
      UNION ALL SELECT 'l_extendedprice', 'tax_paid', abs(corr(l_extendedprice, tax_paid)) FROM x
      UNION ALL SELECT 'l_tax', 'tax_paid', abs(corr(l_tax, tax_paid)) FROM x
      UNION ALL SELECT 'twice', 'tax_paid', abs(corr(twice, tax_paid)) FROM x
      UNION ALL SELECT 'l_quantity', 'l_extendedprice', abs(corr(l_quantity, l_extendedprice)) FROM x
      UNION ALL SELECT 'l_discount', 'l_tax', abs(corr(l_discount, l_tax)) FROM x)
    SELECT feature_a, feature_b, round(r, 6) AS abs_corr FROM c WHERE r > 0.5""",
)
def high_corr(spark, d):
    out = Q.high_corr_pairs(derived(spark, d), threshold=0.5)
    return out.withColumn("abs_corr", F.round("abs_corr", 6))


@query(
    "high_corr_features",
    f"""WITH x AS ({DERIVED})
    SELECT CASE WHEN abs(corr(l_extendedprice, twice)) > 0.85 THEN 'l_extendedprice,twice' END AS feature_names FROM x""",
)
def high_corr_features(spark, d):
    out = Q.high_corr_features(Q.high_corr_pairs(derived(spark, d)))
    return out.select(F.array_join("high_corr_features", ",").alias("feature_names"))


_VALIDATE = f"""
    x AS ({HOLES}),
    u AS (SELECT feature, v FROM x UNPIVOT (v FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))),
    q AS (SELECT feature, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
                 quantile_cont(v, 0.999) AS hi FROM u GROUP BY feature),
    t AS (SELECT u.feature, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS o,
                 count(*) FILTER (v < lo OR v > hi) AS r, min(v) = max(v) AS k
          FROM u JOIN q ON u.feature = q.feature GROUP BY u.feature),
    dup AS (SELECT coalesce(sum(k) FILTER (k > 1), 0) AS dups FROM
            (SELECT count(*) AS k FROM x GROUP BY l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag)),
    cls AS (SELECT max(k) / min(k) AS ratio FROM (SELECT count(*) AS k FROM x GROUP BY l_returnflag)),
    f AS (
      SELECT count(*) AS rows,
             (count(*) FILTER (l_discount IS NULL) + count(*) FILTER (l_tax IS NULL)) / (count(*) * 4) * 100
               AS missing_total_pct,
             (SELECT dups FROM dup) / count(*) * 100 AS duplicates_pct,
             (SELECT sum(o) FROM t)::BIGINT AS outliers_total,
             (SELECT count(*) FILTER (k) FROM t) AS constant_features,
             0::BIGINT AS object_columns,
             (SELECT count(*) FILTER (r > 0) FROM t) AS invalid_range_features,
             (abs(corr(l_quantity, l_extendedprice)) > 0.85)::BIGINT
               + (abs(corr(l_discount, l_tax)) > 0.85)::BIGINT AS high_corr_pairs,
             (SELECT ratio FROM cls) AS imbalance_ratio
      FROM x),
    scored AS (
      SELECT *, 100 * (1 - least(1.0, least(1.0, missing_total_pct / 20) * 0.28 + least(1.0, duplicates_pct / 10) * 0.12
               + least(1.0, outliers_total / 200) * 0.20 + least(1.0, object_columns / 10) * 0.12
               + least(1.0, invalid_range_features / 10) * 0.10 + least(1.0, constant_features / 10) * 0.05
               + least(1.0, high_corr_pairs / 100) * 0.03 + least(1.0, (imbalance_ratio - 1) / 9) * 0.10))
             AS quality_score FROM f)"""


@query(
    "quality_score",
    f"""WITH {_VALIDATE}
    SELECT rows, round(missing_total_pct, 6) AS missing_total_pct, round(duplicates_pct, 6) AS duplicates_pct,
           outliers_total, constant_features, object_columns, invalid_range_features, high_corr_pairs,
           round(imbalance_ratio, 6) AS imbalance_ratio, round(quality_score, 6) AS quality_score FROM scored""",
)
def quality_score(spark, d):
    out = Q.quality_score(Q.quality_findings(holes(spark, d), "l_returnflag"))
    rounded = ("missing_total_pct", "duplicates_pct", "imbalance_ratio", "quality_score")
    return out.drop("entropy").withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "validate",
    f"""WITH {_VALIDATE}
    SELECT round(quality_score, 6) AS quality_score, CASE WHEN quality_score >= 75 THEN 'pass' ELSE 'fail' END AS status,
           concat_ws(',', CASE WHEN missing_total_pct > 5 THEN 'missing_values_too_high' END,
                          CASE WHEN duplicates_pct > 1 THEN 'duplicates_too_high' END,
                          CASE WHEN outliers_total > 10 THEN 'outliers_too_many' END,
                          CASE WHEN invalid_range_features > 0 THEN 'invalid_ranges_detected' END,
                          CASE WHEN imbalance_ratio > 5 THEN 'class_imbalance_too_high' END,
                          CASE WHEN constant_features > 0 THEN 'constant_features_detected' END) AS fail_reasons
    FROM scored""",
)
def validate(spark, d):
    out = Q.validate(holes(spark, d), "l_returnflag")
    return out.select(
        F.round("quality_score", 6).alias("quality_score"),
        "status",
        F.array_join("fail_reasons", ",").alias("fail_reasons"),
    )


@query(
    "validate_by_priority",
    """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.001) AS lo, quantile_cont(o_totalprice, 0.25) AS q1,
                         quantile_cont(o_totalprice, 0.75) AS q3, quantile_cont(o_totalprice, 0.999) AS hi
                  FROM orders GROUP BY ALL)
    SELECT o.o_orderpriority, count(*) AS rows,
           count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers_total,
           (count(*) FILTER (o_totalprice < lo OR o_totalprice > hi) > 0)::BIGINT AS invalid_range_features
    FROM orders o JOIN q ON o.o_orderpriority = q.o_orderpriority GROUP BY ALL""",
)
def validate_by_priority(spark, d):
    orders = table(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderstatus")
    out = Q.validate(orders, "o_orderstatus", by=["o_orderpriority"])
    return out.select("o_orderpriority", "rows", "outliers_total", "invalid_range_features")


@query(
    "schema_diff",
    """WITH c AS (SELECT DISTINCT user_id::VARCHAR AS dataset, event_type AS col FROM events
                  WHERE ts >= TIMESTAMP '2024-01-08'),
    b AS (SELECT DISTINCT user_id::VARCHAR AS dataset, event_type AS col FROM events WHERE ts < TIMESTAMP '2024-01-08'),
    j AS (SELECT coalesce(c.dataset, b.dataset) AS dataset, c.col AS cc, b.col AS bc
          FROM c FULL JOIN b ON c.dataset = b.dataset AND c.col = b.col)
    SELECT dataset, count(bc) > 0 AS has_baseline,
           coalesce(string_agg(cc, ',' ORDER BY cc) FILTER (bc IS NULL), '') AS new_columns,
           coalesce(string_agg(bc, ',' ORDER BY bc) FILTER (cc IS NULL), '') AS missing_columns
    FROM j GROUP BY dataset""",
)
def schema_diff(spark, d):
    """Users as data sets and the event types they show as columns: the events from 8 January on against those before."""
    ev = table(spark, d, "events")
    rows = ev.select("ts", F.col("user_id").cast("string").alias("dataset"), F.col("event_type").alias("column"))
    cur = rows.where("ts >= timestamp_ntz'2024-01-08'").drop("ts")
    base = rows.where("ts < timestamp_ntz'2024-01-08'").drop("ts")
    out = Q.compare_schema(cur, base)
    return out.withColumns({c: F.array_join(c, ",") for c in ("new_columns", "missing_columns")})


_PROFILE = """count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min,
      round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50,
      round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max, count(*) - count(v) AS missing,
      round((count(*) - count(v)) / count(*) * 100, 2) AS missing_pct, round(skewness(v), 4) AS skewness,
      round(kurtosis(v), 4) AS kurtosis"""


@query(
    "profile",
    f"""WITH h AS ({HOLES}),
    u AS (SELECT feature, v FROM h UNPIVOT INCLUDE NULLS (v FOR feature IN
          (l_quantity, l_extendedprice, l_discount, l_tax)))
    SELECT feature, {_PROFILE} FROM u GROUP BY feature""",
)
def profile(spark, d):
    return P.profile(holes(spark, d))


@query(
    "profile_events",
    f"SELECT event_type, 'value' AS feature, {_PROFILE} FROM (SELECT event_type, value AS v FROM events) GROUP BY event_type",
)
def profile_events(spark, d):
    return P.profile(table(spark, d, "events"), ["value"], by=["event_type"])


@query(
    "basic_stats",
    """SELECT feature, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max
    FROM (SELECT p_size::DOUBLE AS p_size, p_retailprice FROM part)
    UNPIVOT (v FOR feature IN (p_size, p_retailprice)) GROUP BY feature""",
)
def basic_stats(spark, d):
    out = P.basic_stats(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "dataset_stats",
    f"""WITH h AS ({HOLES})
    SELECT count(*) AS n_samples, count(*) FILTER (l_discount IS NULL) + count(*) FILTER (l_tax IS NULL) AS missing_values,
           4::BIGINT AS n_features, count(DISTINCT l_returnflag) AS n_classes FROM h""",
)
def dataset_stats(spark, d):
    return P.dataset_stats(holes(spark, d), "l_returnflag")


@query(
    "dataset_stats_regression",
    """SELECT count(*) AS n_samples, 0::BIGINT AS missing_values, 3::BIGINT AS n_features,
           round(avg(o_totalprice), 4) AS target_mean, round(stddev_samp(o_totalprice), 4) AS target_std,
           round(min(o_totalprice), 4) AS target_min, round(max(o_totalprice), 4) AS target_max FROM orders""",
)
def dataset_stats_regression(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return P.dataset_stats(orders, "o_totalprice", task="regression")


@query(
    "class_distribution",
    """SELECT c_mktsegment AS class, round(count(*) / sum(count(*)) OVER (), 4) AS share
    FROM customer GROUP BY c_mktsegment""",
)
def class_distribution(spark, d):
    return P.class_distribution(table(spark, d, "customer"), "c_mktsegment")


@query(
    "feature_analysis",
    f"""WITH x AS ({DERIVED})
    SELECT 1::BIGINT AS low_variance_features, 0.0::DOUBLE AS variance_min,
           round(count(*) / (count(*) - 1), 8) AS variance_max,
           (abs(corr(l_extendedprice, twice)) > 0.85)::BIGINT AS high_corr_pairs FROM x""",
)
def feature_analysis(spark, d):
    out = P.feature_analysis(derived(spark, d), ["l_quantity", "l_extendedprice", "one", "twice"])
    return out.withColumns({c: F.round(c, 8) for c in ("variance_min", "variance_max")})


@query(
    "feature_alignment",
    "SELECT round(sum(l_tax), 2) AS tax, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem",
)
def feature_alignment(spark, d):
    """Features of lineitem without the target, reordered to what a model expects."""
    feats = features(table(spark, d, "lineitem"), "l_returnflag")
    out = align(feats, ["l_tax", "l_quantity"])
    return out.agg(
        F.round(F.sum("l_tax"), 2).alias("tax"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n")
    )


@query(
    "backfill",
    """SELECT coalesce(nullif(event_type, 'error'), props, 'none') AS kind, count(*) AS n FROM events GROUP BY 1""",
)
def backfill_query(spark, d):
    ev = table(spark, d, "events").withColumn("event_type", F.nullif(F.col("event_type"), F.lit("error")))
    out = backfill(ev, {"event_type": ["props"]})
    return out.groupBy(F.coalesce("event_type", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "retention",
    """SELECT o_orderstatus, count(*) AS n FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-06-30' - INTERVAL 30 DAY GROUP BY o_orderstatus""",
)
def retention(spark, d):
    kept = retain(table(spark, d, "orders"), "o_orderdate", "1998-06-30 00:00:00", 30)
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "preview",
    """SELECT l_linestatus, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_linestatus
                                   ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
    WHERE rn <= 10""",
)
def preview_query(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return preview(li, ["l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 10)
