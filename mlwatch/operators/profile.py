"""Descriptive statistics of feature tables and KPI roll-ups of experiment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlwatch.functions.columns import clean, missing, numeric_cols, quoted
from mlwatch.functions.json import metric
from mlwatch.functions.stats import pct_of, safe_div, sample_kurtosis, sample_skewness
from mlwatch.operators.frames import attach, grouped, melt_stats, settled, side_by_side
from mlwatch.operators.order import approx_quantiles, exact_quantiles
from mlwatch.operators.quality import correlations
from mlwatch.operators.split import standardize


def profile(
    df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """count, mean, std, min, quartiles, max, missing, skewness and kurtosis per numeric feature, to four digits."""
    cols = list(cols) if cols is not None else numeric_cols(df, by)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(cols):
        v = clean(df, c)
        aggs += [
            F.count(v).alias(f"c{i}_count"),
            F.avg(v).alias(f"c{i}_mean"),
            F.stddev_samp(v).alias(f"c{i}_std"),
            F.var_samp(v).alias(f"c{i}_var"),
            F.min(v).alias(f"c{i}_min"),
            F.max(v).alias(f"c{i}_max"),
            F.skewness(v).alias(f"c{i}_g1"),
            F.kurtosis(v).alias(f"c{i}_g2"),
        ]
    quantiles = approx_quantiles if approx else exact_quantiles
    wide = attach(grouped(df, by).agg(*aggs), quantiles(df, cols, [0.25, 0.5, 0.75], by), by)
    wide = wide.withColumns({f"c{i}_q": F.col(f"_s.c{i}_q") for i in range(len(cols))})
    wide = wide.withColumns({f"c{i}_rows": F.col("rows") for i in range(len(cols))})
    names = ["rows", "count", "mean", "std", "var", "min", "q", "max", "g1", "g2"]
    long = melt_stats(wide, by, cols, {n: n for n in names})
    gap = F.col("rows") - F.col("count")

    def r4(c):
        return F.round(c, 4)

    return long.select(
        *by,
        "feature",
        "count",
        r4(F.col("mean")).alias("mean"),
        r4(F.col("std")).alias("std"),
        r4(F.col("min")).alias("min"),
        *[r4(F.get("q", F.lit(k))).alias(n) for k, n in enumerate(("p25", "p50", "p75"))],
        r4(F.col("max")).alias("max"),
        gap.alias("missing"),
        F.round(pct_of(gap, F.col("rows")), 2).alias("missing_pct"),
        r4(sample_skewness(F.col("count"), F.col("var"), F.col("g1"))).alias("skewness"),
        r4(sample_kurtosis(F.col("count"), F.col("var"), F.col("g2"))).alias("kurtosis"),
    )


def basic_stats(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """mean, std, min and max per numeric feature, ordered by feature."""
    cols = list(cols) if cols is not None else numeric_cols(df, by)
    aggs = []
    for i, c in enumerate(cols):
        v = clean(df, c)
        aggs += [
            F.avg(v).alias(f"c{i}_mean"),
            F.stddev_samp(v).alias(f"c{i}_std"),
            F.min(v).alias(f"c{i}_min"),
            F.max(v).alias(f"c{i}_max"),
        ]
    names = ("mean", "std", "min", "max")
    return melt_stats(grouped(df, by).agg(*aggs), by, cols, {n: n for n in names}).orderBy(*by, "feature")


def dataset_stats(
    df: DataFrame, target: str, task: str = "classification", split: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Size, missing cells and a target summary of a data set; train and test size come from the split column."""
    feats = [c for c in df.columns if c not in (target, split) and c not in by]
    gaps = F.lit(0).cast("bigint")
    for c in feats:
        gaps = gaps + F.count_if(missing(df, c))
    aggs = [F.count("*").alias("n_samples"), gaps.alias("missing_values")]
    if split:
        aggs += [
            F.count_if(F.col(split) == "train").alias("train_size"),
            F.count_if(F.col(split) == "test").alias("test_size"),
        ]
    if task != "classification":
        y = clean(df, target)
        aggs += [
            F.round(F.avg(y), 4).alias("target_mean"),
            F.round(F.stddev_samp(y), 4).alias("target_std"),
            F.round(F.min(y), 4).alias("target_min"),
            F.round(F.max(y), 4).alias("target_max"),
        ]
    out = grouped(df, by).agg(*aggs).withColumn("n_features", F.lit(len(feats)).cast("bigint"))
    if task == "classification":
        classes = df.where(~missing(df, target)).groupBy(*by, target).agg(F.count("*").alias("k"))
        out = side_by_side([out, grouped(classes, by).agg(F.count("*").alias("n_classes"))], by)
    return out


def class_distribution(df: DataFrame, target: str, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Share of each class among rows with a class, rounded."""
    known = df.where(~missing(df, target))
    totals = settled(grouped(known, by).agg(F.count("*").alias("n")))
    counts = known.groupBy(*by, F.col(quoted(target)).alias("class")).agg(F.count("*").alias("k"))
    return attach(counts, totals, by).select(*by, "class", F.round(safe_div(F.col("k"), F.col("_s.n")), digits).alias("share"))


def feature_analysis(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), corr: float = 0.85, low_var: float = 0.01
) -> DataFrame:
    """After standardising: how many pairs correlate, how many features barely vary, and the range of variances."""
    scaled = standardize(df, cols, by=by)
    aggs = [F.var_samp(clean(scaled, c)) for c in cols]
    wide = grouped(scaled, by).agg(F.array(*aggs).alias("v"))
    spread = wide.select(
        *by,
        F.size(F.filter("v", lambda x: x < low_var)).cast("bigint").alias("low_variance_features"),
        F.array_min("v").alias("variance_min"),
        F.array_max("v").alias("variance_max"),
    )
    pairs = grouped(correlations(scaled, cols, by), by).agg(
        F.count_if(F.col("abs_corr") > corr).alias("high_corr_pairs")
    )
    return side_by_side([spread, pairs], by)


def split_summary(df: DataFrame, split: str, target: str) -> DataFrame:
    """Rows, features, missing cells and class proportions per split.

    ``class_shares`` lists ``class=share`` with four digits, by class; a missing class is ``null``. Rows are counted by split and class
    within tasks, so that what moves is one row per class.
    """
    feats = [c for c in df.columns if c not in (target, split)]
    gaps = F.lit(0).cast("bigint")
    for c in feats:
        gaps = gaps + F.count_if(missing(df, c))
    label = F.coalesce(F.when(~missing(df, target), F.col(quoted(target)).cast("string")), F.lit("null"))
    cells = df.groupBy(split, label.alias("label")).agg(F.count("*").alias("k"), gaps.alias("gaps"))
    out = cells.groupBy(split).agg(
        F.sum("k").alias("rows"),
        F.lit(len(feats)).cast("bigint").alias("features"),
        F.sum("gaps").alias("missing_values"),
        F.array_sort(F.collect_list(F.struct("label", "k"))).alias("classes"),
    )
    shares = F.transform("classes", lambda c: F.format_string("%s=%.4f", c["label"], c["k"] / F.col("rows")))
    return out.withColumn("class_shares", F.array_join(shares, ", ")).drop("classes")


# ---------------------------------------------------------------------------------------------------------------
# Experiments and models


def experiment_kpis(exps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Run count, best accuracy, mean duration, success rate and platform score from an experiments table."""
    acc = metric(F.col("metrics"), "accuracy")
    s = grouped(exps, by).agg(
        F.count("*").alias("runs"),
        F.coalesce(F.max(F.coalesce(acc, F.lit(0.0))), F.lit(0.0)).alias("best_accuracy"),
        F.avg(F.round(F.coalesce(F.col("duration_seconds"), F.lit(0.0)), 2)).alias("avg_duration"),
        F.coalesce(F.avg((F.coalesce("status", F.lit("")) == "completed").cast("double")) * 100.0, F.lit(100.0)).alias(
            "success_pct"
        ),
    )
    score = F.col("success_pct") * 0.5 + F.least(F.col("best_accuracy") * 100.0, F.lit(100.0)) * 0.5
    return s.withColumn("platform_score", score.cast("int"))


def stage_counts(models: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Models per lifecycle stage."""
    return models.groupBy(*by, "stage").agg(F.count("*").alias("models"))


def stage_board(models: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same counts with one column per stage."""
    stages = ["development", "staging", "production", "archived"]
    return models.groupBy(*by).agg(*[F.count_if(F.col("stage") == s).alias(s) for s in stages])


def duration_series(exps: DataFrame) -> DataFrame:
    """Run durations along time."""
    return exps.select(F.col("created_at").alias("ts"), "duration_seconds").orderBy("ts")


def activity_feed(exps: DataFrame, n: int = 6) -> DataFrame:
    """The newest runs as (HH:MM, "model on dataset", status)."""
    newest = exps.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)
    return newest.select(
        F.date_format("created_at", "HH:mm").alias("time"),
        F.concat_ws(" on ", "model_type", "dataset").alias("label"),
        "status",
    )
