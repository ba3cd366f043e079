"""Distribution drift between a reference and current data.

Two measures per feature: the population stability index over equal-width bins, and the two-sample
Kolmogorov-Smirnov distance. Two samples are compared by counts per part of the value range, and only parts that can
hold the largest difference send values. Many windows against one reference are reduced to distinct values with counts
and sorted in value buckets, so one feature is never one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.functions.columns import clean, clean_sql, common_cols, numeric_cols, quoted
from mlwatch.functions.stats import equal_width_bin, ks_pvalue, safe_div
from mlwatch.operators.frames import attach, grouped, long_values, melt_stats, settled
from mlwatch.operators.narrowing import edges_agg, largest_gap
from mlwatch.operators.order import bucket_count, bucketed, sliced_scan

# Default thresholds.
ALPHA = 0.05
PSI_MODERATE = 0.10
PSI_SIGNIFICANT = 0.25
FEATURE_RATIO = 0.20
P_SIGNIFICANT = 0.01
RATIO_CRITICAL = 0.50


def drift_columns(ref: DataFrame, cur: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns both sides have, in reference order."""
    both = set(numeric_cols(ref, exclude)) & set(numeric_cols(cur, exclude))
    return [c for c in common_cols(ref, cur) if c in both]


def both_sides(ref: DataFrame, cur: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One frame of both samples: ``side`` is 0 for the reference and 1 for current rows."""

    def pick(df: DataFrame, side: int) -> DataFrame:
        return df.select(
            *[F.col(quoted(k)) for k in by], *[clean(df, c).alias(c) for c in cols], F.lit(side).alias("side")
        )

    return pick(ref, 0).unionByName(pick(cur, 1))


def side_stats(
    both: DataFrame, cols: Sequence[str], by: Sequence[str], n_bins: int, buckets: int | None = None
) -> DataFrame:
    """Per group and feature: sizes, common range, bins, and (for sorting) cut points, from one wide pass."""
    aggs = []
    for i, c in enumerate(cols):
        v = quoted(c)
        aggs += [
            F.expr(f"count_if(side = 0 AND {v} IS NOT NULL) AS c{i}_nr"),
            F.expr(f"count_if(side = 1 AND {v} IS NOT NULL) AS c{i}_nc"),
            F.expr(f"min({v}) AS c{i}_lo"),
            F.expr(f"max({v}) AS c{i}_hi"),
        ]
        if buckets:
            aggs.append(edges_agg(v, buckets).alias(f"c{i}_edges"))
    fields = {"n_ref": "nr", "n_cur": "nc", "lo": "lo", "hi": "hi"} | ({"edges": "edges"} if buckets else {})
    return settled(with_bins(melt_stats(grouped(both, by).agg(*aggs), by, cols, fields), n_bins))


def with_bins(stats: DataFrame, n_bins: int) -> DataFrame:
    """Adds ``ranged`` (whether the index is defined: two values on each side and a finite, non-empty range), the
    number of bins ``nb`` (one per fifteen rows of the smaller sample, two to ``n_bins``) and their width ``step``."""
    inf = "CAST('Infinity' AS DOUBLE)"
    return (
        stats.withColumn(
            "ranged",
            F.expr(f"coalesce(n_ref >= 2 AND n_cur >= 2 AND lo > -{inf} AND hi < {inf} AND hi > lo, false)"),
        )
        .withColumn("nb", F.expr(f"CAST(greatest(2, least({n_bins}, least(n_ref, n_cur) DIV 15)) AS INT)"))
        .withColumn("step", F.expr("IF(ranged, (hi - lo) / nb, NULL)"))
    )


def psi_from_bins(bins: Sequence[tuple[str, str]], n_ref: str, n_cur: str, nb: str) -> Column:
    """The index from (reference, current) counts per bin with +1 smoothing; bins beyond ``nb`` do not count.

    Arguments are SQL expressions.
    """
    terms = []
    for j, (r, c) in enumerate(bins):
        rp = f"((coalesce({r}, 0) + 1D) / ({n_ref} + {nb}))"
        cp = f"((coalesce({c}, 0) + 1D) / ({n_cur} + {nb}))"
        terms.append(f"IF({nb} > {j}, ({cp} - {rp}) * ln({cp} / {rp}), 0D)")
    return F.expr(" + ".join(terms))


def bin_sums(n_bins: int) -> list[Column]:
    """Aggregates that turn (bin, r, c) rows into columns r0, c0, r1, c1, ..."""
    return [F.expr(f"sum(IF(bin = {j}, {s}, 0L)) AS {s}{j}") for j in range(n_bins) for s in ("r", "c")]


def psi(
    ref: DataFrame, cur: DataFrame, cols: Sequence[str], n_bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Population stability index per feature, rounded to five digits; 0 where it is undefined.

    Only bin counts are shuffled: at most ``n_bins`` rows per task, group and feature.
    """
    both = both_sides(ref, cur, cols, by)
    stats = side_stats(both, cols, by, n_bins)
    long = attach(long_values(both, [*by, "side"], cols), stats, [*by, "feature"])
    binned = (
        long.where("_s.ranged")
        .withColumn("bin", equal_width_bin("value", "_s.lo", "_s.step", "_s.nb", n_bins))
        .groupBy(*by, "feature", "bin")
        .agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    )
    wide = binned.groupBy(*by, "feature").agg(*bin_sums(n_bins))
    out = attach(stats, settled(wide), [*by, "feature"])
    return out.select(*by, "feature", _psi_column(n_bins, "_s.").alias("psi"))


def _psi_column(n_bins: int, prefix: str) -> Column:
    pairs = [(f"{prefix}r{j}", f"{prefix}c{j}") for j in range(n_bins)]
    value = psi_from_bins(pairs, "n_ref", "n_cur", "nb")
    return F.when(F.col("ranged"), F.round(value, 5)).otherwise(0.0)


def _distances(ref: DataFrame, cur: DataFrame, cols: Sequence[str], n_bins: int, by: Sequence[str]) -> DataFrame:
    """Unrounded KS distance and the index per feature.

    The distance is found by bound and prune; the counts of its first round also tell those of the index's bins.
    """
    keys = [*by, "feature"]
    both = both_sides(ref, cur, cols, by)
    stats = side_stats(both, cols, by, n_bins)
    cells = attach(long_values(both, [*by, "side"], cols), stats, keys)
    cells = cells.select(
        *keys, "side", "value", F.when(F.col("_s.ranged"), equal_width_bin("value", "_s.lo", "_s.step", "_s.nb", n_bins)).alias("psi_bin")
    )
    d, by_bin, _ = largest_gap(cells, stats.where("n_ref > 0 AND n_cur > 0"), keys, ["psi_bin"])
    wide = by_bin.withColumnRenamed("psi_bin", "bin").groupBy(*keys).agg(*bin_sums(n_bins))
    out = stats.withColumn("_key", F.struct(*keys))
    for found, name in ((wide, "_s"), (d, "_d")):
        out = out.join(found.select(F.struct(*keys).alias("_key"), F.struct(*[c for c in found.columns if c not in keys]).alias(name)), "_key", "left")
    return out.select(*keys, "n_ref", "n_cur", F.col("_d.d").alias("d"), _psi_column(n_bins, "_s.").alias("psi"))


def ks(ref: DataFrame, cur: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and asymptotic p-value per feature, unrounded."""
    d = _distances(ref, cur, cols, 2, by)
    return d.select(
        *by,
        "feature",
        F.col("d").alias("ks_statistic"),
        ks_pvalue(F.col("d"), F.col("n_ref"), F.col("n_cur")).alias("p_value"),
    )


def severity(
    psi_: Column,
    p: Column,
    alpha: float = ALPHA,
    moderate: float = PSI_MODERATE,
    significant: float = PSI_SIGNIFICANT,
) -> Column:
    """none, moderate or significant for one feature."""
    return (
        F.when((psi_ > significant) | (p < P_SIGNIFICANT), "significant")
        .when((psi_ > moderate) | (p < alpha), "moderate")
        .otherwise("none")
    )


def _graded(d: DataFrame, by: Sequence[str], alpha: float, moderate: float, significant: float) -> DataFrame:
    p = ks_pvalue(F.col("d"), F.col("n_ref"), F.col("n_cur"))
    d = d.withColumn("p", p)
    return d.select(
        *by,
        "feature",
        F.round("d", 5).alias("ks_statistic"),
        F.round("p", 5).alias("p_value"),
        "psi",
        F.coalesce((F.col("p") < alpha) | (F.col("psi") > moderate), F.lit(False)).alias("drift_detected"),
        severity(F.col("psi"), F.col("p"), alpha, moderate, significant).alias("severity"),
    )


def drift_features(
    ref: DataFrame,
    cur: DataFrame,
    cols: Sequence[str] | None = None,
    alpha: float = ALPHA,
    moderate: float = PSI_MODERATE,
    significant: float = PSI_SIGNIFICANT,
    n_bins: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """Drift report per feature over the numeric columns both sides share."""
    cols = list(cols) if cols is not None else drift_columns(ref, cur, by)
    return _graded(_distances(ref, cur, cols, n_bins, by), by, alpha, moderate, significant)


def overall_severity(
    ratio: Column,
    avg_psi: Column,
    ratio_warning: float = FEATURE_RATIO,
    moderate: float = PSI_MODERATE,
    significant: float = PSI_SIGNIFICANT,
) -> Column:
    """critical, warning or stable for a whole report."""
    return (
        F.when((ratio >= RATIO_CRITICAL) | (avg_psi >= significant), "critical")
        .when((ratio >= ratio_warning) | (avg_psi >= moderate), "warning")
        .otherwise("stable")
    )


def drift_summary(
    feats: DataFrame,
    by: Sequence[str] = (),
    feature_ratio: float = FEATURE_RATIO,
    moderate: float = PSI_MODERATE,
    significant: float = PSI_SIGNIFICANT,
) -> DataFrame:
    """One row per report: how many features drifted, and how severe that is."""
    s = grouped(feats, by).agg(
        F.count("*").alias("features_analyzed"),
        F.count_if("drift_detected").alias("features_drifted"),
        F.coalesce(F.avg("psi"), F.lit(0.0)).alias("avg"),
    )
    ratio = F.coalesce(safe_div(F.col("features_drifted"), F.col("features_analyzed")), F.lit(0.0))
    return s.withColumn("ratio", ratio).select(
        *by,
        "features_analyzed",
        "features_drifted",
        F.round("ratio", 4).alias("drift_ratio"),
        (F.col("ratio") > feature_ratio).alias("overall_drift"),
        overall_severity(F.col("ratio"), F.col("avg"), feature_ratio, moderate, significant).alias("overall_severity"),
        F.round("avg", 5).alias("average_psi"),
    )


def drift_health(summary: DataFrame) -> DataFrame:
    """Health score 0..100 from the average index; STABLE above 75."""
    score = F.floor(100.0 - F.least(F.col("average_psi") * 2.0, F.lit(1.0)) * 100.0).cast("int")
    return summary.withColumn("health_score", score).withColumn(
        "health_label", F.when(F.col("health_score") > 75, "STABLE").otherwise("DRIFTED")
    )


def significant_count(feats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of features graded significant."""
    return grouped(feats, by).agg(F.count_if(F.col("severity") == "significant").alias("significant_features"))


def drift_history(reports: DataFrame, n: int = 15) -> DataFrame:
    """The newest ``n`` stored reports."""
    return reports.orderBy(F.desc("created_at"), F.desc("report_id")).limit(n)


def drift_alerts(summary: DataFrame, dataset: Column | str) -> DataFrame:
    """One alert row per report that shows overall drift."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    meta = F.to_json(
        F.struct(name.alias("dataset"), F.col("drift_ratio"), F.col("average_psi"), F.col("features_drifted"))
    )
    return summary.where("overall_drift").select(
        F.col("overall_severity").alias("severity"),
        F.concat(
            F.lit("Data drift detected for dataset="),
            name,
            F.lit("; ratio="),
            F.format_string("%.2f", F.col("drift_ratio")),
        ).alias("message"),
        meta.alias("metadata"),
    )


def perturb(df: DataFrame, cols: Sequence[str], noise: float = 0.0, shift: float = 0.0, seed: int = 7) -> DataFrame:
    """Add normal noise and then a constant to each column; both must lie in 0..10."""
    for label, v in (("noise_level", noise), ("mean_shift", shift)):
        if not 0 <= v <= 10:
            raise ValueError(f"{label} must be between 0 and 10")
    out = {}
    for i, c in enumerate(cols):
        col = F.col(quoted(c)).cast("double")
        if noise > 0:
            col = col + F.randn(seed + i) * F.lit(float(noise))
        if shift > 0:
            col = col + F.lit(float(shift))
        out[c] = col
    return df.withColumns(out)


def drift_by_group(
    ref: DataFrame,
    cur: DataFrame,
    group: Sequence[str],
    cols: Sequence[str],
    by: Sequence[str] = (),
    alpha: float = ALPHA,
    moderate: float = PSI_MODERATE,
    significant: float = PSI_SIGNIFICANT,
    n_bins: int = 10,
) -> DataFrame:
    """Many current samples (``group``: time windows, batches) against one reference, which is never copied per group.

    The Kolmogorov-Smirnov distance of a sample is reached at one of the sample's own values, just before or just
    after it, so it is enough to know the reference's rank at those values. The index likewise needs the
    reference's rank at the sample's bin edges. Both become query points in one ordered pass over the reference.
    """
    keys, feat = [*by, *group, "feature"], [*by, "feature"]
    buckets = bucket_count(ref.sparkSession)

    def sizes(df: DataFrame, ks_: Sequence[str], n: str, edges: bool) -> DataFrame:
        aggs = []
        for i, c in enumerate(cols):
            v = clean_sql(df, c)
            aggs += [F.expr(f"{fn}({v}) AS c{i}_{sfx}") for fn, sfx in (("count", "n"), ("min", "lo"), ("max", "hi"))]
            if edges:
                aggs.append(edges_agg(v, buckets).alias(f"c{i}_edges"))
        fields = {n: "n", "lo": "lo", "hi": "hi"} | ({"edges": "edges"} if edges else {})
        return settled(melt_stats(grouped(df, ks_).agg(*aggs), ks_, cols, fields))

    ref_stats = sizes(ref, by, "n_ref", True)
    cur_sizes = sizes(cur, [*by, *group], "n_cur", True)
    with_ref = attach(cur_sizes, ref_stats, feat)
    cur_stats = settled(
        with_bins(
            with_ref.select(
                *keys,
                "n_cur",
                F.coalesce(F.col("_s.n_ref"), F.lit(0).cast("bigint")).alias("n_ref"),
                F.least("lo", F.col("_s.lo")).alias("lo"),
                F.greatest("hi", F.col("_s.hi")).alias("hi"),
                "edges",
            ),
            n_bins,
        )
    )

    # Current values per group, and the bin edges each group asks the reference about.
    cur_counts = (
        long_values(cur, [F.col(quoted(k)) for k in (*by, *group)], cols)
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("c"))
    )
    inner = "inline(transform(sequence(1, nb - 1), k -> named_struct('edge', k, 'value', k * step + lo)))"
    edge_points = cur_stats.where("ranged").select(*keys, F.expr(inner))

    ref_counts = (
        long_values(ref, [F.col(quoted(k)) for k in by], cols).groupBy(*feat, "value").agg(F.count("*").alias("r"))
    )
    zero = F.lit(0).cast("bigint").alias("r")
    points = cur_counts.select(*feat, "value", zero).unionByName(edge_points.select(*feat, "value", zero))
    ordered = ref_counts.unionByName(points).groupBy(*feat, "value").agg(F.sum("r").alias("r"))
    placed = bucketed(ordered, ref_stats.select(*feat, "edges"), feat, "value", buckets)
    ranks = sliced_scan(placed, feat, ["value"], F.col("bucket"), total={"lt": F.col("r")})
    ranks = ranks.select(F.struct(*feat, "value").alias("_at"), "lt", (F.col("lt") + F.col("r")).alias("le"))

    # Index: reference counts between neighbouring edges, current counts by bin.
    asked = edge_points.withColumn("_at", F.struct(*feat, "value")).join(ranks, "_at").groupBy(*keys).agg(
        *[F.expr(f"max(IF(edge = {j}, lt, NULL)) AS e{j}") for j in range(1, n_bins)]
    )
    spread = bucketed(cur_counts, cur_stats, keys, "value", buckets)
    cum = sliced_scan(spread, keys, ["value"], F.col("bucket"), total={"before": F.col("c")})
    cum = cum.withColumn("bin", equal_width_bin("value", "lo", "step", "nb", n_bins))
    met = cum.withColumn("_at", F.struct(*feat, "value")).join(ranks, "_at")
    after = F.abs(safe_div(F.col("le"), F.col("n_ref")) - safe_div(F.col("before") + F.col("c"), F.col("n_cur")))
    ahead = F.abs(safe_div(F.col("lt"), F.col("n_ref")) - safe_div(F.col("before"), F.col("n_cur")))
    found = met.groupBy(*keys).agg(
        F.max(F.greatest(after, ahead)).alias("d"),
        *[F.expr(f"sum(IF(bin = {j}, c, 0L)) AS c{j}") for j in range(n_bins)],
    )

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*keys).alias("_key"), F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    out = (
        cur_stats.drop("edges")
        .withColumn("_key", F.struct(*keys))
        .join(packed(found, "_c"), "_key", "left")
        .join(packed(asked, "_r"), "_key", "left")
    )
    below = ["0L", *[f"coalesce(_r.e{j}, n_ref)" for j in range(1, n_bins)], "n_ref"]
    bins = [(f"({below[j + 1]} - {below[j]})", f"_c.c{j}") for j in range(n_bins)]
    index = F.when(F.col("ranged"), F.round(psi_from_bins(bins, "n_ref", "n_cur", "nb"), 5)).otherwise(0.0)
    d = out.select(
        *keys,
        "n_ref",
        "n_cur",
        F.when((F.col("n_ref") > 0) & (F.col("n_cur") > 0), F.col("_c.d")).alias("d"),
        index.alias("psi"),
    )
    return _graded(d, [*by, *group], alpha, moderate, significant)


def drift_by_window(
    ref: DataFrame, cur: DataFrame, ts: str, width: str, cols: Sequence[str], by: Sequence[str] = (), **kw
) -> DataFrame:
    """A drift report per tumbling time window of the current data against one reference."""
    timed = cur.withColumn("window_start", F.window(F.col(quoted(ts)), width).start)
    return drift_by_group(ref, timed, ["window_start"], cols, by, **kw)


__all__ = [
    "ALPHA",
    "drift_alerts",
    "drift_by_group",
    "drift_by_window",
    "drift_columns",
    "drift_features",
    "drift_health",
    "drift_history",
    "drift_summary",
    "ks",
    "perturb",
    "psi",
    "severity",
    "significant_count",
]
