"""Data-quality checks, the quality score, and the full validation verdict."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlwatch.functions.columns import clean, clean_sql, missing, numeric_cols, object_cols, quoted
from mlwatch.functions.stats import pct_of, safe_div
from mlwatch.operators.frames import attach, grouped, key_of, melt_stats, settled, side_by_side
from mlwatch.operators.order import approx_quantiles, exact_quantiles

# Penalty weights of the quality score.
WEIGHTS = {
    "missing": 0.28,
    "duplicates": 0.12,
    "outliers": 0.20,
    "types": 0.12,
    "ranges": 0.10,
    "imbalance": 0.10,
    "constant": 0.05,
    "correlation": 0.03,
}

# The finding at which each penalty is full.
FULL_PENALTY = {
    "missing": 20.0,
    "duplicates": 10.0,
    "outliers": 200.0,
    "types": 10.0,
    "ranges": 10.0,
    "constant": 10.0,
    "correlation": 100.0,
}

# Default thresholds of a validation.
THRESHOLDS = {
    "missing_total_pct": 5.0,
    "duplicates_pct": 1.0,
    "outliers_total": 10,
    "constant_features": 0,
    "object_columns": 0,
    "invalid_ranges_features": 0,
    "imbalance_ratio": 5.0,
    "quality_score_min": 75.0,
}
MANY_CORRELATED_PAIRS = 20

# Fail reasons and advice.
ADVICE = {
    "missing_values_too_high": "Impute missing values or remove highly sparse columns/rows.",
    "duplicates_too_high": "Deduplicate rows prior to training (or use aggregation).",
    "outliers_too_many": "Cap/winsorize outliers or use robust scaling for affected features.",
    "dtype_mismatch_suspected": "Cast features to numeric types and ensure schema matches training expectations.",
    "invalid_ranges_detected": "Validate feature ranges; investigate upstream data generation/units.",
    "class_imbalance_too_high": "Use stratified sampling, class weights, or resampling to address imbalance.",
    "constant_features_detected": "Remove constant (zero-variance) features to improve model reliability.",
    "high_correlation": "Consider removing one of highly correlated features to reduce multicollinearity.",
    "empty_frame": "Provide non-empty training data before validation.",
    "missing_target_column": "Ensure target column is present for validation.",
    "passed": "Validation passed. Ready for training.",
}



FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

# ---------------------------------------------------------------------------------------------------------------
# Single checks


def _missing_aggs(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    return [F.count_if(missing(df, c)).alias(f"c{i}_miss") for i, c in enumerate(cols)]


def missing_report(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Missing cells per column, most affected first; nulls and NaN both count."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in by]
    wide = grouped(df, by).agg(F.count("*").alias("rows"), *_missing_aggs(df, cols))
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}_miss").alias("missing_count")) for i, c in enumerate(cols)]
    long = wide.select(*by, "rows", F.inline(F.array(*cells)))
    return long.select(
        *by, "column", "missing_count", pct_of(F.col("missing_count"), F.col("rows")).alias("missing_pct")
    ).orderBy(*by, F.desc("missing_count"), "column")


def missing_total(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Missing cells over all columns, and their share of all cells."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in by]
    wide = grouped(df, by).agg(F.count("*").alias("rows"), *_missing_aggs(df, cols))
    total = _sum_of([F.col(f"c{i}_miss") for i in range(len(cols))])
    return wide.select(
        *by,
        total.alias("total_missing"),
        pct_of(total, F.col("rows") * F.lit(len(cols))).alias("total_missing_pct"),
    )


def _sum_of(cols: Sequence[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for c in cols:
        out = out + c
    return out


def duplicate_report(
    df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (), two_step: bool | None = None
) -> DataFrame:
    """Rows that occur more than once, all copies counted; missing equals missing.

    Rows of numbers and times are grouped as they are: copies collapse before the shuffle. Rows with columns of other
    types, whose values may be long (or ``two_step``), first shuffle only a 64-bit hash; the rows whose hash repeats are
    then compared in full, so collisions change nothing.
    """
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in by]
    if two_step is None:
        two_step = any(not isinstance(df.schema[c].dataType, FIXED_WIDTH) for c in cols)
    fields = [f"d{i}" for i in range(len(cols))]
    rows = df.select(*by, *[_null_for_nan(df, c).alias(f) for f, c in zip(fields, cols, strict=True)])
    sizes = grouped(rows, by).agg(F.count("*").alias("rows"))
    if two_step:
        hashed = rows.withColumn("_h", F.xxhash64(*by, *fields))
        again = hashed.groupBy("_h").agg(F.count("*").alias("k")).where("k > 1").select("_h")
        rows = hashed.join(again, "_h", "left_semi").drop("_h")
    copies = grouped(rows.groupBy(*by, *fields).agg(F.count("*").alias("k")).where("k > 1"), by).agg(
        F.sum("k").alias("dups")
    )
    out = side_by_side([sizes, copies], by)
    dups = F.coalesce("dups", F.lit(0)).cast("bigint")
    return out.select(*by, dups.alias("duplicate_rows"), pct_of(dups, F.col("rows")).alias("duplicate_rows_pct"))


def _null_for_nan(df: DataFrame, name: str) -> Column:
    """The column as a grouping value: NaN becomes null, so the two kinds of missing equal each other."""
    kind = df.schema[name].dataType
    col = F.col(quoted(name))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return F.to_json(F.struct(col)) if isinstance(kind, (T.MapType, T.VariantType)) else col


def constant_report(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Features without spread. Numeric ones need two values; if there are none, any type with at most one distinct value."""
    names = list(cols) if cols is not None else [c for c in df.columns if c not in by]
    wide, picked = _constant_wide(df, names, by)
    return melt_stats(wide, by, picked, {"is_constant": "const"}).where("is_constant").select(*by, "feature")


def _constant_aggs(df: DataFrame, names: Sequence[str]) -> tuple[list[Column], list[str], bool]:
    numeric = [c for c in numeric_cols(df) if c in set(names)]
    if numeric:
        aggs = []
        for i, c in enumerate(numeric):
            v = clean(df, c)
            aggs += [F.min(v).alias(f"c{i}_min"), F.max(v).alias(f"c{i}_max"), F.count(v).alias(f"c{i}_cnt")]
        return aggs, numeric, True
    # Distinct counting is not needed to see whether there is at most one value: compare the extremes.
    aggs = []
    for i, c in enumerate(names):
        v = F.to_json(F.struct(F.col(quoted(c)).alias("v")))
        aggs += [F.min(v).alias(f"c{i}_min"), F.max(v).alias(f"c{i}_max")]
    return aggs, list(names), False


def _constant_flags(picked: Sequence[str], numeric: bool) -> list[Column]:
    flags = []
    for i, _ in enumerate(picked):
        same = F.col(f"c{i}_min") == F.col(f"c{i}_max")
        if numeric:
            same = same & (F.col(f"c{i}_cnt") >= 2)
        flags.append(F.coalesce(same, F.lit(False)).alias(f"c{i}_const"))
    return flags


def _constant_wide(df: DataFrame, names: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    aggs, picked, numeric = _constant_aggs(df, names)
    return grouped(df, by).agg(*aggs).select(*by, *_constant_flags(picked, numeric)), picked


def type_mismatch_report(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Text and nested columns where features should be numeric, with how many values would not cast to a number."""
    names = object_cols(df, by) if cols is None else [c for c in object_cols(df, by) if c in set(cols)]
    if not names:
        return df.sparkSession.createDataFrame(
            [], T.StructType([*[df.schema[k] for k in by], *_MISMATCH_FIELDS])
        )
    aggs = []
    for i, c in enumerate(names):
        v = F.col(quoted(c))
        bad = v.isNotNull()
        if isinstance(df.schema[c].dataType, T.StringType):
            bad = bad & v.try_cast("double").isNull()
        aggs.append(F.count_if(bad).alias(f"c{i}_bad"))
    wide = grouped(df, by).agg(*aggs)
    rows = melt_stats(wide, by, names, {"non_numeric_values": "bad"})
    kinds = F.create_map(*[F.lit(x) for c in names for x in (c, df.schema[c].dataType.simpleString())])
    return rows.select(*by, "feature", kinds[F.col("feature")].alias("dtype"), "non_numeric_values")


_MISMATCH_FIELDS = [
    T.StructField("feature", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("non_numeric_values", T.LongType()),
]


def _tail_counts(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str],
    limits: DataFrame,
    bounds: Mapping[str, tuple[int, int]] | None,
    z: float | None,
) -> DataFrame:
    """Wide row per group: ``n_rows`` and, per column, the count of values outside each pair of limits."""
    near = attach(df, limits, by)
    aggs = [F.count("*").alias("n_rows")]
    for i, c in enumerate(cols):
        v = clean_sql(df, c)
        if z is not None:
            mean, std = f"_s.c{i}_mean", f"_s.c{i}_std"
            aggs.append(F.expr(f"count_if({std} <> 0 AND abs({v} - {mean}) / nullif({std}, 0D) > {float(z)!r}D) AS c{i}_out"))
        for name, (a, b) in (bounds or {}).items():
            lo, hi = f"_s.c{i}_q[{a}]", f"_s.c{i}_q[{b}]"
            if name == "out":
                iqr = f"({hi} - {lo})"
                lo, hi = f"({lo} - 1.5D * {iqr})", f"({hi} + 1.5D * {iqr})"
            aggs.append(F.expr(f"count_if({v} < {lo} OR {v} > {hi}) AS c{i}_{name}"))
    return grouped(near, by).agg(*aggs)


def _zscore_limits(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        v = clean(df, c)
        aggs += [F.avg(v).alias(f"c{i}_mean"), F.stddev_samp(v).alias(f"c{i}_std")]
    return settled(grouped(df, by).agg(*aggs))


def outlier_report(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    method: str = "iqr",
    z: float = 3.0,
    by: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """Outliers per numeric feature by the 1.5 IQR rule or by |z| above a limit, most affected first."""
    cols = list(cols) if cols is not None else numeric_cols(df, by)
    if method == "zscore":
        wide = _tail_counts(df, cols, by, _zscore_limits(df, cols, by), None, z)
    else:
        quantiles = approx_quantiles if approx else exact_quantiles
        wide = _tail_counts(df, cols, by, quantiles(df, cols, [0.25, 0.75], by), {"out": (0, 1)}, None)
    return _counted(wide, cols, by, "out", "outlier_count", "outlier_pct").orderBy(
        *by, F.desc("outlier_count"), "feature"
    )


def range_report(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    lo: float = 0.001,
    hi: float = 0.999,
    by: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """Values outside a low and a high quantile per numeric feature."""
    cols = list(cols) if cols is not None else numeric_cols(df, by)
    quantiles = approx_quantiles if approx else exact_quantiles
    wide = _tail_counts(df, cols, by, quantiles(df, cols, [lo, hi], by), {"rng": (0, 1)}, None)
    return _counted(wide, cols, by, "rng", "invalid_count", "invalid_pct").orderBy(
        *by, F.desc("invalid_count"), "feature"
    )


def _counted(wide: DataFrame, cols: Sequence[str], by: Sequence[str], sfx: str, count: str, pct: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"c{i}_{sfx}").alias(count)) for i, c in enumerate(cols)]
    long = wide.select(*by, "n_rows", F.inline(F.array(*cells)))
    return long.select(*by, "feature", count, pct_of(F.col(count), F.col("n_rows")).alias(pct))


def class_balance(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and share per class; a missing class is a class of its own."""
    counts = settled(df.groupBy(*by, _null_for_nan(df, target).cast("string").alias("class")).agg(F.count("*").alias("count")))
    totals = settled(grouped(counts, by).agg(F.sum("count").alias("n")))
    return attach(counts, totals, by).select(
        *by, "class", "count", pct_of(F.col("count"), F.col("_s.n")).alias("pct")
    )


def class_summary(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Imbalance ratio (null below two classes) and entropy in bits, without a second look at the rows.

    With S = sum of counts, the entropy is log2 S - sum(c log2 c) / S, so one pass over the class counts is enough.
    """
    counts = df.groupBy(*by, _null_for_nan(df, target).alias("class")).agg(F.count("*").alias("k"))
    k = F.col("k").cast("double")
    s = grouped(counts, by).agg(
        F.count("*").alias("n_classes"),
        F.max("k").alias("hi"),
        F.min("k").alias("lo"),
        F.sum("k").alias("n"),
        F.sum(k * F.log2(k)).alias("klogk"),
    )
    return s.select(
        *by,
        "n_classes",
        F.when(F.col("n_classes") >= 2, safe_div(F.col("hi"), F.col("lo"))).alias("imbalance_ratio"),
        F.when(F.col("n") > 0, F.greatest(F.lit(0.0), F.log2(F.col("n").cast("double")) - safe_div(F.col("klogk"), F.col("n")))).alias("entropy"),
    )


# ---------------------------------------------------------------------------------------------------------------
# Correlation


def _centre_aggs(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Per column: values present, their mean, and the extremes."""
    return [
        F.expr(f"{fn}({clean_sql(df, c)}) AS m{i}_{fn}") for i, c in enumerate(cols) for fn in ("count", "avg", "min", "max")
    ]


def _pair_correlations(df: DataFrame, cols: Sequence[str], by: Sequence[str], stats: DataFrame) -> DataFrame:
    """(keys, a, b, r): Pearson correlation of all column pairs by their places; null where one side has no spread.

    ``stats`` is settled and holds the values of ``_centre_aggs``. Columns are centred first, so plain sums of products
    are safe. One scan, whatever the number of columns: each task multiplies the matrix of its rows with itself, batch
    by batch, with missing cells as zeros and a second matrix that marks them, and hands over one row per pair and group.
    """
    # A constant column is centred on its own value, which leaves exact zeros.
    cells = [
        F.expr(f"{clean_sql(df, c)} - IF(_s.m{i}_min = _s.m{i}_max, _s.m{i}_min, _s.m{i}_avg)") for i, c in enumerate(cols)
    ]
    centred = attach(df, stats, by).select(key_of(by).alias("_key") if by else F.lit(0).alias("_key"), F.array(*cells).alias("_z"))
    d = len(cols)
    first, second = np.triu_indices(d, 1)
    sums = ("n", "sa", "sb", "qa", "qb", "x")
    numbers = [T.StructField(c, T.IntegerType()) for c in "ab"] + [T.StructField(c, T.DoubleType()) for c in sums]
    schema = T.StructType([centred.schema["_key"], *numbers])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for batch in batches:
            keys = batch.column("_key")
            names = [repr(k) for k in keys.to_pylist()] if by else [""] * batch.num_rows
            z = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)
            codes, labels = pd.factorize(np.array(names, dtype=object))
            for code, label in enumerate(labels):
                own = np.flatnonzero(codes == code)
                part = z[own]
                there = ~np.isnan(part)
                part, mark = np.where(there, part, 0.0), there.astype(float)
                s, q = part.T @ mark, (part * part).T @ mark
                found = np.stack([(mark.T @ mark)[first, second], s[first, second], s[second, first], q[first, second], q[second, first], (part.T @ part)[first, second]])
                if label in held:
                    held[label][1][...] += found
                else:
                    held[label] = (keys.slice(int(own[0]), 1), found)
        for key, found in held.values():
            repeated = key.take(pa.array(np.zeros(len(first), np.int64)))
            places = [pa.array(x.astype(np.int32)) for x in (first, second)]
            yield pa.RecordBatch.from_arrays([repeated, *places, *[pa.array(x) for x in found]], schema.names)

    total = centred.mapInArrow(multiply, schema).groupBy("_key", "a", "b").agg(*[F.sum(c).alias(c) for c in sums])

    def spread(sq: str, su: str) -> str:
        """Squared deviations; rounding noise around a constant is none."""
        left = f"({sq} - try_divide({su} * {su}, n))"
        return f"IF({left} > 1e-13D * {sq}, {left}, NULL)"

    r = f"(x - try_divide(sa * sb, n)) / sqrt({spread('qa', 'sa')} * {spread('qb', 'sb')})"
    keys = [F.col("_key").getField(k).alias(k) for k in by]
    # Rounding may pass one by a hair; least and greatest would turn a null into a bound.
    return total.select(*keys, "a", "b", F.expr(f"IF({r} IS NULL, NULL, greatest(-1D, least(1D, {r}))) AS r"))


def correlations(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Absolute Pearson correlation of every column pair over rows where both have a value; null without spread.

    Two scans, one for the means and one for all pairs.
    """
    cols = list(cols) if cols is not None else numeric_cols(df, by)
    if len(cols) < 2:
        text = [T.StructField(n, T.StringType()) for n in ("feature_a", "feature_b")]
        schema = [*[df.schema[k] for k in by], *text, T.StructField("abs_corr", T.DoubleType())]
        return df.sparkSession.createDataFrame([], T.StructType(schema))
    stats = settled(grouped(df, by).agg(*_centre_aggs(df, cols)))
    names = F.array(*map(F.lit, cols))
    pairs = _pair_correlations(df, cols, by, stats)
    return pairs.select(*by, F.get(names, "a").alias("feature_a"), F.get(names, "b").alias("feature_b"), F.abs("r").alias("abs_corr"))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def high_corr_pairs(
    df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.85, by: Sequence[str] = ()
) -> DataFrame:
    """Pairs whose absolute correlation exceeds the threshold."""
    return correlations(df, cols, by).where(F.col("abs_corr") > threshold)


def high_corr_features(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sorted names of the features that occur in any of the given pairs."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("feature_a", "feature_b")))))
    return grouped(pairs, by).agg(names.alias("high_corr_features"))


# ---------------------------------------------------------------------------------------------------------------
# Score and verdict


def quality_score(findings: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Adds ``quality_score``: 100 less the weighted penalties, each capped at its weight.

    ``findings`` has missing_total_pct, duplicates_pct, outliers_total, object_columns, invalid_range_features,
    constant_features, high_corr_pairs and imbalance_ratio.
    """
    w = dict(weights or WEIGHTS)
    columns = {
        "missing": "missing_total_pct",
        "duplicates": "duplicates_pct",
        "outliers": "outliers_total",
        "types": "object_columns",
        "ranges": "invalid_range_features",
        "constant": "constant_features",
        "correlation": "high_corr_pairs",
    }
    penalty = F.lit(0.0)
    for part, col in columns.items():
        penalty = penalty + F.least(F.lit(1.0), F.col(col) / F.lit(FULL_PENALTY[part])) * F.lit(w[part])
    imbalance = F.least(F.lit(1.0), (F.col("imbalance_ratio") - 1.0) / F.lit(9.0)) * F.lit(w["imbalance"])
    penalty = penalty + F.coalesce(imbalance, F.lit(0.0))
    score = 100.0 * (1.0 - F.least(F.lit(1.0), penalty))
    return findings.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def quality_findings(
    df: DataFrame,
    target: str,
    task: str = "classification",
    by: Sequence[str] = (),
    outlier_method: str = "iqr",
    z: float = 3.0,
    quantiles: tuple[float, float] = (0.001, 0.999),
    corr_threshold: float = 0.85,
    approx: bool = False,
) -> DataFrame:
    """Every check of a validation as one row per group.

    One wide pass carries missing cells, extremes and means; one more the products of pairs; the quantile passes ask for all four cut-offs at
    once; duplicates and classes are one aggregation each.
    """
    feats = [c for c in df.columns if c != target and c not in by]
    nums = [c for c in numeric_cols(df, by) if c != target]
    const_aggs, const_cols, const_numeric = _constant_aggs(df, feats)
    base = settled(
        grouped(df, by).agg(
            F.count("*").alias("rows"), *_missing_aggs(df, feats), *const_aggs, *_centre_aggs(df, nums)
        )
    )
    flags = _constant_flags(const_cols, const_numeric)
    total_missing = _sum_of([F.col(f"c{i}_miss") for i in range(len(feats))])
    parts = [
        base.withColumns({f"c{i}_const": f for i, f in enumerate(flags)}).select(
            *by,
            "rows",
            pct_of(total_missing, F.col("rows") * F.lit(len(feats))).alias("missing_total_pct"),
            _sum_of([F.col(f"c{i}_const").cast("bigint") for i in range(len(const_cols))]).alias("constant_features"),
        ),
        duplicate_report(df, [*feats, target], by).select(*by, F.col("duplicate_rows_pct").alias("duplicates_pct")),
    ]
    if len(nums) > 1:
        found = _pair_correlations(df, nums, by, base)
        close = F.count_if(F.abs("r") > F.lit(float(corr_threshold)))
        parts.append(grouped(found, by).agg(close.alias("high_corr_pairs")))
    if nums:
        quant = approx_quantiles if approx else exact_quantiles
        limits = quant(df, nums, [quantiles[0], 0.25, 0.75, quantiles[1]], by)
        bounds = {"rng": (0, 3)}
        if outlier_method == "zscore":
            limits = settled(side_by_side([limits, _zscore_limits(df, nums, by)], by))
            tails = _tail_counts(df, nums, by, limits, bounds, z)
        else:
            tails = _tail_counts(df, nums, by, limits, {**bounds, "out": (1, 2)}, None)
        parts.append(
            tails.select(
                *by,
                _sum_of([F.col(f"c{i}_out") for i in range(len(nums))]).alias("outliers_total"),
                _sum_of([(F.col(f"c{i}_rng") > 0).cast("bigint") for i in range(len(nums))]).alias(
                    "invalid_range_features"
                ),
            )
        )
    if task == "classification":
        parts.append(class_summary(df, target, by).select(*by, "imbalance_ratio", "entropy"))
    out = side_by_side(parts, by)
    null = F.lit(None).cast("double")
    zero = F.lit(0).cast("bigint")
    out = out.withColumns(
        {
            "high_corr_pairs": F.coalesce(F.col("high_corr_pairs"), zero) if len(nums) > 1 else zero,
            "object_columns": F.lit(len([c for c in object_cols(df, by) if c != target])).cast("bigint"),
            **({} if nums else {"outliers_total": zero, "invalid_range_features": zero}),
            **({} if task == "classification" else {"imbalance_ratio": null, "entropy": null}),
        }
    )
    return out.select(
        *by,
        "rows",
        "missing_total_pct",
        "duplicates_pct",
        "outliers_total",
        "constant_features",
        "object_columns",
        "invalid_range_features",
        "high_corr_pairs",
        "imbalance_ratio",
        "entropy",
    )


def validate(
    df: DataFrame,
    target: str,
    task: str = "classification",
    by: Sequence[str] = (),
    thresholds: Mapping[str, float] | None = None,
    weights: Mapping[str, float] | None = None,
    **checks,
) -> DataFrame:
    """Findings, score, status, fail reasons and recommendations: one row, or one per group."""
    limit = {**THRESHOLDS, **(thresholds or {})}
    if target not in df.columns:
        rows = grouped(df, by).agg(F.count("*").alias("rows"))
        reason = F.when(F.col("rows") == 0, "empty_frame").otherwise("missing_target_column")
        return rows.select(
            *by,
            "rows",
            F.lit(0.0).alias("quality_score"),
            F.lit("fail").alias("status"),
            F.array(reason).alias("fail_reasons"),
            F.array(
                F.when(F.col("rows") == 0, ADVICE["empty_frame"]).otherwise(ADVICE["missing_target_column"])
            ).alias("recommendations"),
        )
    scored = quality_score(quality_findings(df, target, task, by, **checks), weights)

    def over(col: str, key: str) -> Column:
        return F.coalesce(F.col(col) > F.lit(limit[key]), F.lit(False))

    rules = [
        (over("missing_total_pct", "missing_total_pct"), "missing_values_too_high"),
        (over("duplicates_pct", "duplicates_pct"), "duplicates_too_high"),
        (over("outliers_total", "outliers_total"), "outliers_too_many"),
        (over("object_columns", "object_columns"), "dtype_mismatch_suspected"),
        (over("invalid_range_features", "invalid_ranges_features"), "invalid_ranges_detected"),
        (over("imbalance_ratio", "imbalance_ratio"), "class_imbalance_too_high"),
        (over("constant_features", "constant_features"), "constant_features_detected"),
    ]
    reasons = [F.when(c, name) for c, name in rules]
    reasons.append(F.when(F.col("high_corr_pairs") >= MANY_CORRELATED_PAIRS, "high_correlation_too_many_pairs"))
    advice = [F.when(c, ADVICE[name]) for c, name in rules]
    advice.append(F.when(F.col("high_corr_pairs") > 0, ADVICE["high_correlation"]))
    empty = F.col("rows") == 0
    score = F.when(empty, 0.0).otherwise(F.col("quality_score"))
    out = scored.withColumn("quality_score", score).withColumns(
        {
            "status": F.when(F.col("quality_score") >= limit["quality_score_min"], "pass").otherwise("fail"),
            "_why": F.array_compact(F.array(*reasons)),
            "_do": F.array_compact(F.array(*advice)),
        }
    )
    failed = F.col("status") == "fail"
    return out.withColumns(
        {
            "fail_reasons": F.when(empty, F.array(F.lit("empty_frame")))
            .when(failed & (F.size("_why") == 0), F.array(F.lit("quality_score_below_minimum")))
            .otherwise(F.col("_why")),
            "recommendations": F.when(empty, F.array(F.lit(ADVICE["empty_frame"])))
            .when(~failed & (F.size("_do") == 0), F.array(F.lit(ADVICE["passed"])))
            .otherwise(F.col("_do")),
        }
    ).drop("_why", "_do")


class BelowQuality(Exception):
    """Training must stop: the data did not reach the required quality."""

    def __init__(self, dataset: str, quality_score: float, min_quality_score: float, fail_reasons: Sequence[str]):
        super().__init__(f"{dataset} scores {quality_score:.2f}, and {min_quality_score:.2f} is needed")
        self.dataset = dataset
        self.quality_score = quality_score
        self.min_quality_score = min_quality_score
        self.fail_reasons = list(fail_reasons)


def require_quality(verdict: DataFrame, dataset: str, minimum: float = THRESHOLDS["quality_score_min"]) -> None:
    """Raise unless the one-row verdict of ``validate`` reaches the minimum score."""
    row = verdict.select("quality_score", "fail_reasons").first()
    if row["quality_score"] < minimum:
        raise BelowQuality(dataset, float(row["quality_score"]), float(minimum), row["fail_reasons"])


def compare_schema(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """New and missing columns per dataset, both sides given as (dataset, column) rows.

    A dataset without any baseline row reports all of its columns as new.
    """
    cur = current.select("dataset", "column").distinct().withColumn("_cur", F.lit(True))
    base = baseline.select("dataset", "column").distinct().withColumn("_base", F.lit(True))
    both = cur.join(base, ["dataset", "column"], "full")
    return both.groupBy("dataset").agg(
        F.coalesce(F.bool_or("_base"), F.lit(False)).alias("has_baseline"),
        F.sort_array(F.collect_list(F.when(F.col("_base").isNull(), F.col("column")))).alias("new_columns"),
        F.sort_array(F.collect_list(F.when(F.col("_cur").isNull(), F.col("column")))).alias("missing_columns"),
    )
