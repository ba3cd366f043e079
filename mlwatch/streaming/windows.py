"""Windowed aggregates, gauges, drift and quality counters on unbounded input.

Event time must be a timestamp with time zone semantics (watermarks accept no other type); ``with_event_time`` casts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.functions.columns import clean, missing, quoted
from mlwatch.functions.stats import equal_width_bin
from mlwatch.functions.text import ERROR_KEYWORDS, ERROR_OTHER, ERROR_TYPES, error_category
from mlwatch.operators.alerting import GROUP_BY, REPEAT_SECONDS, dedup_repeat
from mlwatch.operators.drift import drift_features, psi_from_bins, side_stats, with_bins
from mlwatch.operators.frames import long_values, settled
from mlwatch.operators.order import exact_quantiles
from mlwatch.operators.telemetry import bucket_counts, wide_quantile

DELAY = "10 minutes"


def with_event_time(stream: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """The stream with its event time as a timestamp and a watermark on it."""
    return stream.withColumn(ts, F.col(quoted(ts)).cast("timestamp")).withWatermark(ts, delay)


def _window(ts: str, seconds: int, slide: int | None = None) -> Column:
    return F.window(F.col(quoted(ts)), f"{seconds} seconds", f"{slide or seconds} seconds")


def stream_rate(
    stream: DataFrame, ts: str, labels: Sequence[str] = (), seconds: int = 300, slide: int | None = None
) -> DataFrame:
    """Events per second per window and label."""
    counts = stream.groupBy(_window(ts, seconds, slide).alias("w"), *labels).agg(F.count("*").alias("events"))
    return counts.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *labels,
        "events",
        (F.col("events") / F.lit(float(seconds))).alias("per_second"),
    )


def stream_histogram(
    stream: DataFrame,
    ts: str,
    value: str,
    buckets: Sequence[float],
    labels: Sequence[str] = (),
    seconds: int = 300,
    q: float = 0.95,
) -> DataFrame:
    """Cumulative bucket counts per window as columns, with the estimated quantile of the emitted row."""
    v = F.col(quoted(value)).cast("double")
    wide = stream.groupBy(_window(ts, seconds).alias("w"), *labels).agg(
        F.count(v).alias("total"), F.sum(v).alias("sum"), *bucket_counts(v, buckets)
    )
    return wide.select(
        F.col("w.start").alias("window_start"),
        *labels,
        "total",
        "sum",
        *[f"b{i}" for i in range(len(buckets))],
        wide_quantile(q, buckets).alias("quantile"),
    )


def stream_gauge(stream: DataFrame, labels: Sequence[str], value: str, ts: str, tie: str | None = None) -> DataFrame:
    """Latest value per label; run it in update mode."""
    at = F.struct(ts, *([tie] if tie else []))
    return stream.groupBy(*labels).agg(F.max_by(value, at).alias("value"), F.max(ts).alias("at"))


def reference_bins(ref: DataFrame, cols: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Per feature of a stored reference: its range, its number of bins and its counts per bin, as a settled frame."""
    sizes = side_stats(ref.select(*[clean(ref, c).alias(c) for c in cols], F.lit(0).alias("side")), cols, (), n_bins)
    # The reference alone decides range and bins, as if the current sample were no smaller.
    facts = with_bins(sizes.select("feature", "n_ref", F.col("n_ref").alias("n_cur"), "lo", "hi"), n_bins).drop("n_cur")
    # One row per feature: bounded by the schema.
    long = long_values(ref, [], cols).join(F.broadcast(facts), "feature").where("ranged")
    binned = long.groupBy("feature", equal_width_bin("value", "lo", "step", "nb", n_bins).alias("bin")).agg(
        F.count("*").alias("r")
    )
    wide = binned.groupBy("feature").agg(
        *[F.expr(f"sum(IF(bin = {j}, r, 0L)) AS r{j}") for j in range(n_bins)]
    )
    return settled(facts.join(wide, "feature", "left"))


def stream_drift(
    stream: DataFrame, bins: DataFrame, ts: str, cols: Sequence[str], seconds: int = 86400, n_bins: int = 10
) -> DataFrame:
    """Stability index per window and feature against the bins of a stored reference.

    The bins are the reference's alone: current values outside its range fall into the end bins.
    """
    slim = stream.select(ts, *[clean(stream, c).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(quoted(c)).alias("value")) for c in cols])
    long = slim.select(ts, F.inline(cells)).where(F.col("value").isNotNull())
    # One row per feature: bounded by the schema.
    placed = long.join(F.broadcast(bins), "feature").withColumn(
        "bin", equal_width_bin("value", "lo", "step", "nb", n_bins)
    )
    refs = [F.max(f"r{j}").alias(f"r{j}") for j in range(n_bins)]
    counts = placed.where("ranged").groupBy(_window(ts, seconds).alias("w"), "feature").agg(
        F.count("*").alias("n_cur"),
        *[F.max(c).alias(c) for c in ("n_ref", "nb")],
        *refs,
        *[F.count_if(F.col("bin") == j).alias(f"c{j}") for j in range(n_bins)],
    )
    value = psi_from_bins([(f"r{j}", f"c{j}") for j in range(n_bins)], "n_ref", "n_cur", "nb")
    return counts.select(
        F.col("w.start").alias("window_start"),
        "feature",
        "n_cur",
        F.when(F.col("n_cur") >= 2, F.round(value, 5)).otherwise(0.0).alias("psi"),
    )


def drift_batch_writer(ref: DataFrame, cols: Sequence[str], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores the full drift report of every micro-batch.

    Each batch has its own folder, so a batch that is run again replaces its report.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        drift_features(ref, batch, cols).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def dedup_batch_writer(
    path: str, ts: str = "ts", tie: str = "event_id", by: Sequence[str] = GROUP_BY, seconds: int = REPEAT_SECONDS
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores the alerts of each micro-batch that are sent on, as ``dedup_repeat`` says.

    The last alert sent of each group goes from batch to batch in a folder of its own and leads its group in the next
    one. Batch folders are replaced when a batch is run again. Alerts must come in order between batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        alerts = batch.withColumn("_carried", F.lit(False))
        if batch_id:
            before = spark.read.schema(batch.schema).parquet(f"{path}/state/batch={batch_id - 1}")
            alerts = alerts.unionByName(before.withColumn("_carried", F.lit(True)))
        sent = settled(dedup_repeat(alerts, ts, tie, by, seconds))
        newest = sent.groupBy(*by).agg(F.max_by(F.struct(*batch.columns), ts).alias("_row"))
        newest.select("_row.*").write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        sent.where("NOT _carried").drop("_carried").write.mode("overwrite").parquet(f"{path}/sent/batch={batch_id}")

    return write


def stream_dedup(alerts: DataFrame, path: str, **options) -> DataFrame:
    """Alerts of a stream that are sent on, once everything available is processed; ``path`` lies in the shared folder."""
    query = (
        alerts.writeStream.foreachBatch(dedup_batch_writer(path, **options))
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return alerts.sparkSession.read.schema(alerts.schema).option("recursiveFileLookup", True).parquet(f"{path}/sent")


def quality_limits(
    ref: DataFrame, cols: Sequence[str], lo: float = 0.001, hi: float = 0.999
) -> dict[str, tuple[float, float]]:
    """Low and high quantile of each feature of a reference: two numbers per column."""
    row = exact_quantiles(ref, cols, [lo, hi]).first()
    return {c: (row[f"c{i}_q"][0], row[f"c{i}_q"][1]) for i, c in enumerate(cols)}


def stream_quality(
    stream: DataFrame, ts: str, limits: Mapping[str, tuple[float, float]], seconds: int = 3600
) -> DataFrame:
    """Rows, missing cells and values outside the reference's limits per window and feature."""
    cols = list(limits)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(cols):
        v = clean(stream, c)
        lo, hi = limits[c]
        aggs += [
            F.count_if(missing(stream, c)).alias(f"c{i}_miss"),
            F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"c{i}_out"),
        ]
    wide = stream.groupBy(_window(ts, seconds).alias("w")).agg(*aggs)
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"c{i}_miss").alias("missing_count"),
            F.col(f"c{i}_out").alias("out_of_range"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(F.col("w.start").alias("window_start"), "rows", F.inline(F.array(*cells)))


def stream_log_errors(logs: DataFrame, seconds: int = 300, delay: str = DELAY) -> DataFrame:
    """Records, errors and error share per window and error category of a parsed log stream.

    Records below ERROR have no category; the share is of all records of the window's service.
    """
    failed = F.col("level").isin("ERROR", "CRITICAL")
    category = F.coalesce(
        F.col("error_category"), error_category(F.substring_index("exception", ":", 1), F.col("message"))
    )
    cats = [*dict(ERROR_TYPES), *dict(ERROR_KEYWORDS), ERROR_OTHER]
    rows = logs.where(F.col("timestamp").isNotNull()).withWatermark("timestamp", delay)
    rows = rows.withColumn("_c", F.when(failed, category))
    wide = rows.groupBy(_window("timestamp", seconds).alias("w"), "service").agg(
        F.count("*").alias("records"),
        F.count("_c").alias("errors"),
        *[F.count_if(F.col("_c") == c).alias(c) for c in cats],
    )
    return wide.select(
        F.col("w.start").alias("window_start"),
        "service",
        "records",
        "errors",
        (F.col("errors") / F.col("records")).alias("error_rate"),
        *cats,
    )
