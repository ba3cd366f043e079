"""Structured JSON logs, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields every log record has.
BASE_FIELDS = (
    "level",
    "logger",
    "message",
    "correlation_id",
    "request_id",
    "operation",
    "actor",
    "service",
    "exception",
    "error_category",
)

# The record types of the log with the names and types of their own fields.
EVENT_FIELDS = {
    "dataset_upload": {
        "dataset": "string", "status": "string", "rows": "bigint", "columns": "bigint",
        "file_size_bytes": "bigint", "error": "string",
    },
    "pipeline_run": {
        "run_id": "string", "dataset": "string", "model_type": "string", "status": "string",
        "duration_seconds": "double", "metrics": "string", "error": "string", "stage": "string",
    },
    "experiment_creation": {
        "experiment_id": "string", "exp_name": "string", "dataset": "string", "model_type": "string",
        "status": "string", "metrics": "string", "duration_seconds": "double", "error": "string",
    },
    "model_registration": {
        "model_id": "string", "model_name": "string", "dataset": "string", "version": "int", "stage": "string",
        "status": "string", "metrics": "string", "error": "string",
    },
    "drift_detection": {
        "dataset": "string", "reference_window": "string", "current_window": "string", "status": "string",
        "drift_detected": "boolean", "drift_score": "double", "features_drifted": "int", "error": "string",
    },
    "prediction_request": {
        "model_id": "string", "dataset": "string", "status": "string", "num_predictions": "bigint",
        "duration_ms": "double", "error": "string",
    },
    "model_promotion": {
        "model_id": "string", "model_name": "string", "dataset": "string", "from_stage": "string",
        "to_stage": "string", "status": "string", "error": "string",
    },
    "governance_action": {
        "action": "string", "entity_type": "string", "entity_id": "string", "status": "string",
        "details": "string", "error": "string",
    },
    "dataset_validation": {
        "dataset": "string", "status": "string", "rows": "bigint", "columns": "bigint", "issues": "string",
        "error": "string",
    },
}


def parse_logs(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed log columns from one JSON text per row.

    Each line is parsed once into a variant: ``payload`` keeps every extra field. A line that is not JSON has no
    payload and is kept in ``_corrupt_record``.
    """
    base = lines.withColumn("payload", F.try_parse_json(value))

    def field(name: str, kind: str = "string"):
        return F.try_variant_get("payload", f"$.{name}", kind)

    return base.select(
        *[c for c in lines.columns if c != value],
        F.try_to_timestamp(field("timestamp")).alias("timestamp"),
        *[field(n).alias(n) for n in BASE_FIELDS],
        field("event").alias("event"),
        "payload",
        F.when(F.col("payload").isNull(), F.col(value)).alias("_corrupt_record"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path))


def stream_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.readStream.text(path))


def log_events(logs: DataFrame, event: str) -> DataFrame:
    """The records of one type with their own fields as typed columns."""
    fields = EVENT_FIELDS[event]
    return logs.where(F.col("event") == event).select(
        "timestamp",
        "level",
        "correlation_id",
        "request_id",
        "actor",
        *[F.try_variant_get("payload", f"$.{n}", t).alias(n) for n, t in fields.items()],
    )


def log_rollup(logs: DataFrame, by: Sequence[str] = ("level", "logger", "operation", "actor", "service")) -> DataFrame:
    """Records per combination of log fields, with the time span they cover."""
    return logs.groupBy(*by).agg(
        F.count("*").alias("records"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")
    )


def trace(logs: DataFrame) -> DataFrame:
    """One row per correlation id: number of records and errors, start, end and seconds between them.

    The records themselves stay rows (see ``trace_lines``): a correlation id may have any number of them.
    """
    micros = F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))
    return logs.where(F.col("correlation_id").isNotNull()).groupBy("correlation_id").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        (micros / 1e6).alias("seconds"),
    )


def trace_lines(logs: DataFrame, correlation_id: str) -> DataFrame:
    """The records of one correlation id in time order."""
    return logs.where(F.col("correlation_id") == correlation_id).orderBy("timestamp")
