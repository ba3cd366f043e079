"""Train/test splits, folds and standardisation.

Rows are ordered by a digest of their keys, so an assignment is repeatable on any cluster and can be recomputed in
SQL. Splits and folds differ only in how many rows of each class go where; the rows themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.functions.columns import clean, quoted
from mlwatch.operators.frames import attach, grouped, settled
from mlwatch.operators.order import digest_cuts, row_digest

MAX_CLASSES = 20


def class_group(df: DataFrame, stratify: str | None, max_classes: int = MAX_CLASSES) -> Column:
    """The class as text, a missing one being a class of its own; or one group for all rows without ``stratify``.

    More than ``max_classes`` known classes are an error: raise the number, or pass no column to stratify on.
    """
    if stratify is None:
        return F.lit("all")
    found = df.where(F.col(quoted(stratify)).isNotNull()).select(quoted(stratify)).distinct().count()
    if found > max_classes:
        raise ValueError(f"{stratify} has {found} classes, more than max_classes={max_classes}")
    return F.col(quoted(stratify)).cast("string")


def _assign(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    stratify: str | None,
    quotas: Callable[[DataFrame], DataFrame],
    n_cuts: int,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    group, digest = class_group(df, stratify, max_classes), row_digest(keys, seed)
    cuts = digest_cuts(df, digest, group, quotas, n_cuts)
    return attach(df.withColumns({"_grp": group, "_dig": digest}), cuts.withColumnRenamed("grp", "_grp"), ["_grp"])


def test_quotas(sizes: DataFrame, test_size: float) -> DataFrame:
    """Test rows per class: the test set takes ceil(test_size * n) rows, the training rows are shared out in
    proportion to the classes by largest remainder, and the rest of each class is its test part."""
    total = settled(sizes.agg(F.sum("n").alias("total")))
    few = W.partitionBy(F.lit(0))
    n_train = F.col("_s.total") - F.ceil(F.lit(float(test_size)) * F.col("_s.total"))
    share = F.col("n") / F.col("_s.total") * n_train
    t = attach(sizes, total).select(
        "grp", "n", F.floor(share).alias("base"), (share - F.floor(share)).alias("rest"), n_train.alias("n_train")
    )
    left = F.col("n_train") - F.sum("base").over(few)
    place = F.row_number().over(few.orderBy(F.desc("rest"), "grp"))
    train = F.col("base") + F.when(place <= left, 1).otherwise(0)
    return t.select("grp", F.array((F.col("n") - train).cast("bigint")).alias("upto"))


def split(
    df: DataFrame,
    keys: Sequence[str],
    test_size: float = 0.2,
    seed: int = 42,
    stratify: str | None = None,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Adds ``split`` (train or test). ``keys`` identify a row; rows with equal keys stay on one side."""
    if not 0.05 <= test_size <= 0.5:
        raise ValueError("test_size must be between 0.05 and 0.5")
    near = _assign(df, keys, seed, stratify, lambda s: test_quotas(s, test_size), 1, max_classes)
    side = F.when(F.col("_dig") <= F.col("_s.cut0"), "test").otherwise("train")
    return near.withColumn("split", side).drop("_grp", "_dig", "_s")


def fold_quotas(sizes: DataFrame, k: int) -> DataFrame:
    """Running fold sizes per class: number the rows class after class and deal them out to the folds in turn."""
    start = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("grp")) - F.col("n")

    def dealt(fold: int) -> Column:
        """How many of the positions start .. start+n-1 fall to the folds up to this one."""
        total = F.lit(0)
        for i in range(fold + 1):
            total = total + F.floor((F.col("start") + F.col("n") - 1 - i) / k) - F.floor((F.col("start") - 1 - i) / k)
        return total.cast("bigint")

    return sizes.withColumn("start", start).select("grp", F.array(*[dealt(i) for i in range(k - 1)]).alias("upto"))


def kfold(
    df: DataFrame,
    keys: Sequence[str],
    k: int = 5,
    seed: int = 42,
    stratify: str | None = None,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Adds ``fold`` 0..k-1, sizes per class differing by at most one row."""
    if not 2 <= k <= 10:
        raise ValueError("cv_folds must be between 2 and 10")
    near = _assign(df, keys, seed, stratify, lambda s: fold_quotas(s, k), k - 1, max_classes)
    fold = F.lit(0)
    for i in range(k - 1):
        cut = F.col(f"_s.cut{i}")
        fold = fold + F.when(cut.isNull() | (F.col("_dig") > cut), 1).otherwise(0)
    return near.withColumn("fold", fold.cast("int")).drop("_grp", "_dig", "_s")


def scaler(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per column (``c{i}_mean``, ``c{i}_scale``); no spread scales by 1."""
    fitted = df if fit_on is None else df.where(fit_on)
    aggs = []
    for i, c in enumerate(cols):
        v = clean(df, c)
        aggs += [
            F.avg(v).alias(f"c{i}_mean"),
            F.when(F.min(v) == F.max(v), 1.0).otherwise(F.stddev_pop(v)).alias(f"c{i}_scale"),
        ]
    return settled(grouped(fitted, by).agg(*aggs))


def standardize(
    df: DataFrame, cols: Sequence[str], fit_on: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Centre and scale columns with the statistics of the rows selected by ``fit_on`` (the training part)."""
    near = attach(df, scaler(df, cols, fit_on, by), by, "_scale")
    scaled = {
        c: (clean(df, c) - F.col(f"_scale.c{i}_mean")) / F.col(f"_scale.c{i}_scale") for i, c in enumerate(cols)
    }
    return near.withColumns(scaled).drop("_scale")
