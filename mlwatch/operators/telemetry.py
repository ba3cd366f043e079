"""Counters, gauges, histograms, rates and error shares over event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.functions.columns import quoted
from mlwatch.functions.stats import safe_div
from mlwatch.operators.frames import grouped

# Bucket bounds in seconds of the published histograms.
BUCKETS = {
    "pipeline": (10, 30, 60, 120, 300, 600, 1200, 1800, 3600),
    "stage": (1, 5, 10, 30, 60, 120, 300),
    "request": (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10),
    "prediction": (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1),
    "drift": (0.1, 0.5, 1, 5, 10, 30, 60),
}


def counter(events: DataFrame, labels: Sequence[str], where: Column | None = None) -> DataFrame:
    """Number of events per label combination."""
    rows = events if where is None else events.where(where)
    return grouped(rows, labels).agg(F.count("*").alias("total"))


def gauge(events: DataFrame, labels: Sequence[str], value: str, ts: str, tie: str | None = None) -> DataFrame:
    """Latest value per label combination."""
    at = F.struct(ts, *([tie] if tie else []))
    return grouped(events, labels).agg(F.max_by(value, at).alias("value"), F.max(ts).alias("at"))


def bucket_counts(value: Column, buckets: Sequence[float]) -> list[Column]:
    """Aggregates ``b0, b1, ...``: how many values lie at or below each bound."""
    return [F.count_if(value <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(buckets)]


def buckets_long(wide: DataFrame, labels: Sequence[str], buckets: Sequence[float]) -> DataFrame:
    """Rows (labels, le, bucket_count, total, sum) of a histogram that holds one column per bound."""
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("bucket_count")))
    return wide.select(*labels, F.inline(F.array(*rows)), "total", "sum")


def histogram(
    events: DataFrame, value: str, buckets: Sequence[float], labels: Sequence[str] = ()
) -> DataFrame:
    """Cumulative buckets with count and sum per label combination, in one aggregation."""
    v = F.col(quoted(value)).cast("double")
    wide = grouped(events, labels).agg(
        F.count(v).alias("total"), F.sum(v).alias("sum"), *bucket_counts(v, buckets)
    )
    return buckets_long(wide, labels, buckets)


def bucket_quantile(hist: DataFrame, q: float, labels: Sequence[str] = ()) -> DataFrame:
    """Quantile estimated from cumulative buckets by linear interpolation inside the bucket that holds the rank.

    The first bucket starts at zero; a rank in the unbounded bucket gives the last finite bound.
    """
    w = W.partitionBy(*(labels or [F.lit(0)])).orderBy("le")
    rank = F.lit(q) * F.max("bucket_count").over(W.partitionBy(*(labels or [F.lit(0)])))
    rows = hist.select(
        *labels,
        "le",
        "bucket_count",
        F.lag("le").over(w).alias("lower"),
        F.coalesce(F.lag("bucket_count").over(w), F.lit(0)).alias("below"),
        rank.alias("rank"),
    ).where(F.col("rank") > 0)
    hit = rows.where((F.col("bucket_count") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | F.col("lower").isNull()))
    start = F.coalesce(F.col("lower"), F.lit(0.0))
    share = safe_div(F.col("rank") - F.col("below"), F.col("bucket_count") - F.col("below"))
    inside = start + (F.col("le") - start) * share
    value = (
        F.when(F.col("le") == float("inf"), F.col("lower"))
        .when(F.col("lower").isNull() & (F.col("le") <= 0), F.col("le"))
        .otherwise(inside)
    )
    return hit.select(*labels, value.alias("quantile"))


def wide_quantile(q: float, buckets: Sequence[float]) -> Column:
    """The same estimate from one row that holds the bucket counts as columns ``b0, b1, ...`` and ``total``.

    It needs no window, so it also works on the rows a streaming aggregation emits.
    """
    rank = F.lit(q) * F.col("total")
    out = F.lit(float(buckets[-1]))
    for i in reversed(range(len(buckets))):
        hi = F.lit(float(buckets[i]))
        lo = F.lit(float(buckets[i - 1])) if i else F.lit(0.0)
        below = F.col(f"b{i - 1}") if i else F.lit(0)
        inside = lo + (hi - lo) * F.coalesce(safe_div(rank - below, F.col(f"b{i}") - below), F.lit(1.0))
        if i == 0 and buckets[0] <= 0:
            inside = hi
        out = F.when(F.col(f"b{i}") >= rank, inside).otherwise(out)
    return F.when(F.col("total") > 0, out)


def rate(
    events: DataFrame, ts: str, labels: Sequence[str] = (), seconds: int = 300, slide: int | None = None
) -> DataFrame:
    """Events per second in tumbling or sliding windows.

    For a sliding window the events are first counted per slide step; only those counts, not the events, are copied
    into the windows that cover them.
    """
    width = f"{seconds} seconds"
    at = F.col(quoted(ts))
    if slide is None or slide == seconds:
        counts = events.groupBy(F.window(at, width).alias("w"), *labels).agg(F.count("*").alias("n"))
    else:
        if seconds % slide:
            raise ValueError("the window must be a multiple of the slide")
        panes = events.groupBy(F.window(at, f"{slide} seconds").start.alias("pane"), *labels).agg(
            F.count("*").alias("n")
        )
        counts = panes.groupBy(F.window("pane", width, f"{slide} seconds").alias("w"), *labels).agg(
            F.sum("n").alias("n")
        )
    return counts.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *labels,
        F.col("n").alias("events"),
        (F.col("n") / F.lit(float(seconds))).alias("per_second"),
    )


def http_error(status: Column) -> Column:
    """Error type of a response status; null below 400."""
    return F.when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))


def error_rate(requests: DataFrame, error_type: Column, by: Sequence[str] = ()) -> DataFrame:
    """Successes, failures and the share of failures; a null error type is a success."""
    rows = requests.withColumn("_e", error_type)
    failed = F.col("_e").isNotNull()
    return grouped(rows, by).agg(
        F.count_if(~failed).alias("succeeded"),
        F.count_if(failed).alias("failed"),
        F.avg(failed.cast("double")).alias("error_rate"),
    )


def error_counts(requests: DataFrame, error_type: Column, by: Sequence[str] = ()) -> DataFrame:
    """Failures by error type."""
    rows = requests.withColumn("error_type", error_type).where(F.col("error_type").isNotNull())
    return rows.groupBy(*by, "error_type").agg(F.count("*").alias("errors"))


def stage_durations(runs: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Duration statistics per stage from runs with an array ``stages`` of (name, status, duration)."""
    extra = [c for c in by if c != "stage"]
    rows = runs.select(*extra, F.inline("stages")).withColumnRenamed("name", "stage")
    return rows.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.sum("duration").alias("total_seconds"),
        F.avg("duration").alias("avg_seconds"),
        F.max("duration").alias("max_seconds"),
        F.count_if(F.col("status") != "success").alias("failed"),
    )
