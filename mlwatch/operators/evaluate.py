"""Evaluation metrics of predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.functions.columns import clean, quoted
from mlwatch.functions.stats import safe_div
from mlwatch.operators.frames import grouped, settled, side_by_side
from mlwatch.operators.narrowing import edges_agg
from mlwatch.operators.order import bucket_count, bucketed, sliced_scan


# A confusion matrix larger than this squared is an error.
MAX_CLASSES = 1_000


def _cells(df: DataFrame, label: str, pred: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.col(quoted(label)).alias("label"), F.col(quoted(pred)).alias("pred")).agg(
        F.count("*").alias("n")
    )


def class_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 per class; a class nobody predicted or has counts as zero, not as an error."""
    hit = F.when(F.col("label").eqNullSafe(F.col("pred")), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    per = (
        _cells(df, label, pred, by)
        .select(*by, F.inline(roles))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(safe_div(a, b), F.lit(0.0))

    return per.select(
        *by,
        "class",
        "support",
        "tp",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1_score"),
    )


def classification_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, to four digits."""
    per = class_metrics(df, label, pred, by)
    n = F.sum("support")
    return grouped(per, by).agg(
        F.round(safe_div(F.sum("tp"), n), 4).alias("accuracy"),
        *[
            F.round(safe_div(F.sum(F.col(m) * F.col("support")), n), 4).alias(m)
            for m in ("precision", "recall", "f1_score")
        ],
    )


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), max_classes: int = MAX_CLASSES) -> DataFrame:
    """Every cell of the confusion matrix over a group's classes that occur, zeros included.

    A group with more than ``max_classes`` classes is an error, as the matrix has their square.
    """
    cells = settled(_cells(df, label, pred, by))
    known = cells.select(*by, F.explode(F.array("label", "pred")).alias("_class")).where("_class IS NOT NULL").distinct()
    most = grouped(known, by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > max_classes:
        raise ValueError(f"a confusion matrix of {most} classes is larger than max_classes={max_classes}")
    key = F.struct(*by) if by else F.lit(0)
    left = known.select(key.alias("_group"), F.col("_class").alias("label"))
    right = known.select(key.alias("_group"), F.col("_class").alias("pred"))
    cell = F.struct("_group", "label", "pred").alias("_cell")
    counted = cells.withColumn("_group", key).select(cell, "n")
    grid = left.join(right, "_group").select("*", cell).join(counted, "_cell", "left")
    keys = [F.col("_group").getField(k).alias(k) for k in by]
    return grid.select(*keys, "label", "pred", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """The matrix with one column per predicted class, for a known list of classes."""
    cells = _cells(df, label, pred, by)
    return cells.groupBy(*by, "label").agg(
        *[F.coalesce(F.sum(F.when(F.col("pred") == c, F.col("n"))), F.lit(0)).alias(f"pred_{c}") for c in classes]
    )


def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """Positive and negative rows per distinct score, and per group the totals with cut points for sorting."""
    buckets = bucket_count(df.sparkSession)
    rows = df.select(
        *by, clean(df, score).alias("score"), (F.col(quoted(label)).cast("int") == 1).alias("positive")
    ).where(F.col("score").isNotNull() & F.col("positive").isNotNull())
    stats = settled(
        grouped(rows, by).agg(
            F.count_if("positive").alias("p"),
            F.count_if(~F.col("positive")).alias("q"),
            edges_agg("score", buckets).alias("edges"),
        )
    )
    counts = rows.groupBy(*by, "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    return counts, stats, buckets


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve of a 0/1 label, ties counted half; null when one class is absent.

    The rank-sum form: every positive scores the negatives below it. Scores are sorted per bucket; a bucket's
    positives also score all negatives of lower buckets, which one row per bucket is enough to add.
    """
    counts, stats, buckets = _score_counts(df, label, score, by)
    placed = bucketed(counts, stats, by, "score", buckets)
    before = W.partitionBy(*by, "bucket").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0)).cast("double")
    won = F.col("pos").cast("double") * (below + F.col("neg") / 2.0)
    per = (
        placed.withColumn("won", won)
        .groupBy(*by, "bucket")
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    lower = W.partitionBy(*(by or [F.lit(0)])).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("under", F.coalesce(F.sum("neg").over(lower), F.lit(0)).cast("double"))
    won_all = F.sum(F.col("won") + F.col("pos").cast("double") * F.col("under"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return grouped(per, by).agg(safe_div(won_all, pairs).alias("roc_auc"))


def roc_curve(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), drop_intermediate: bool = False
) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the origin with a null threshold.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours.
    """
    counts, stats, buckets = _score_counts(df, label, score, by)
    placed = bucketed(counts, stats, by, "score", buckets)
    last = {"lower": F.struct("pos", "neg")} if drop_intermediate else {}
    keys = list(by)
    if not keys:
        placed, keys = placed.withColumn("_all", F.lit(0)), ["_all"]
    cum = sliced_scan(
        placed, keys, ["score"], F.col("bucket"), last=last, total={"tn": F.col("neg"), "fn": F.col("pos")}
    )
    if drop_intermediate:
        top = (F.col("tn") + F.col("neg") == F.col("q")) & (F.col("fn") + F.col("pos") == F.col("p"))
        bends = (F.col("lower.pos") != F.col("pos")) | (F.col("lower.neg") != F.col("neg"))
        cum = cum.where(F.col("lower").isNull() | top | bends)
    points = cum.select(
        *by,
        F.col("score").alias("threshold"),
        F.round(safe_div(F.col("q") - F.col("tn"), F.col("q")), 6).alias("fpr"),
        F.round(safe_div(F.col("p") - F.col("fn"), F.col("p")), 6).alias("tpr"),
    )
    origin = stats.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def roc_auc_ovr(df: DataFrame, label: str, probs: Mapping[object, str], by: Sequence[str] = ()) -> DataFrame:
    """Mean over classes of the area under the one-versus-rest curve; ``probs`` maps a class to its score column."""
    cells = [
        F.struct(
            F.lit(str(c)).alias("class"),
            (F.col(quoted(label)).cast("string") == F.lit(str(c))).cast("int").alias("is_class"),
            F.col(quoted(col)).cast("double").alias("score"),
        )
        for c, col in probs.items()
    ]
    long = df.select(*by, F.inline(F.array(*cells)))
    per = roc_auc(long, "is_class", "score", [*by, "class"])
    return grouped(per, by).agg(F.avg("roc_auc").alias("roc_auc"))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R squared, to four digits."""
    rows = df.select(*by, clean(df, y).alias("y"), clean(df, yhat).alias("f")).where(
        F.col("y").isNotNull() & F.col("f").isNotNull()
    )
    err = F.col("y") - F.col("f")
    s = grouped(rows, by).agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop("y").alias("var")
    )
    flat = F.when(F.col("mse") == 0, 1.0).when(F.col("mse").isNotNull(), 0.0)
    r2 = F.when(F.col("var") > 0, 1.0 - safe_div(F.col("mse"), F.col("var"))).otherwise(flat)
    return s.select(
        *by, F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round(r2, 4).alias("r2")
    )


def metrics_row(df: DataFrame, label: str, pred: str, score: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """All classification metrics of a run in one row, with the area under the curve when scores are given."""
    parts = [classification_metrics(df, label, pred, by)]
    if score:
        parts.append(roc_auc(df, label, score, by).withColumn("roc_auc", F.round("roc_auc", 4)))
    return side_by_side(parts, by)
