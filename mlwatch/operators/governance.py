"""Activity, alert and schedule tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.functions.json import text_field
from mlwatch.operators.registry import check_limit, newest_first


def activity_counts(activity: DataFrame, by: Sequence[str] = ("user_id", "action")) -> DataFrame:
    """Actions per user (or any other keys), with the time of the latest."""
    return activity.groupBy(*by).agg(F.count("*").alias("actions"), F.max("created_at").alias("last_at"))


def activity_field(activity: DataFrame, key: str) -> DataFrame:
    """One field of the JSON metadata beside each activity row."""
    return activity.withColumn(key, text_field(F.col("metadata_json"), key))


def alerts(table: DataFrame, workspace: int | None = None, n: int = 50) -> DataFrame:
    """Alert events, newest first; a limit outside 1..1000 is an error."""
    where = None if workspace is None else F.col("workspace_id") == workspace
    return newest_first(table, ["created_at", "id"], check_limit(n), where)


def due_schedules(schedules: DataFrame, now: Column | datetime) -> DataFrame:
    """Enabled schedules whose next run is due; an absent or unreadable time is due at once."""
    at = F.lit(now) if isinstance(now, datetime) else now
    due = F.try_to_timestamp(F.col("next_run_at").cast("string"))
    return schedules.where(F.col("enabled").cast("boolean") & (due.isNull() | (due <= at)))


def schedule_status(runs: DataFrame) -> DataFrame:
    """Per schedule: number of runs, last status and success rate in percent."""
    return runs.groupBy("schedule_id").agg(
        F.count("*").alias("runs"),
        F.max_by("status", F.struct("started_at", "status")).alias("last_status"),
        (F.avg((F.col("status") == "success").cast("double")) * 100.0).alias("success_pct"),
    )
