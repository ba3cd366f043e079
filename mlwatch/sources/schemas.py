"""Table schemas of the registry."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


# Names of the registry tables and their columns.
REGISTRY = {
    "experiments": "run_id string, name string, dataset string, model_type string, task string, status string, "
    "started_at timestamp, completed_at timestamp, duration_seconds double, params string, metrics string, "
    "tags string, created_at timestamp",
    "models": "model_id string, run_id string, name string, version int, dataset string, dataset_name string, "
    "model_type string, task string, metrics string, params string, confusion_matrix string, "
    "feature_importances string, experiment_id string, parent_model_id string, artifact_path string, stage string, "
    "created_at timestamp, registered_at timestamp",
    "model_stage_events": "event_id bigint, model_id string, dataset string, from_stage string, to_stage string, "
    "changed_at timestamp, note string",
    "drift_reports": "report_id string, dataset string, reference_size bigint, current_size bigint, "
    "drift_detected boolean, drift_score double, features_drifted int, created_at timestamp",
    "datasets": "dataset_id string, dataset_name string, created_at timestamp",
    "dataset_versions": "dataset_id string, version int, hash string, row_count bigint, column_count int, "
    "missing_values_summary string, created_at timestamp",
    "dataset_schema_snapshots": "dataset_version_id string, column_name string, dtype string",
    "dataset_schema_changes": "dataset_id string, from_version int, to_version int, added_columns array<string>, "
    "removed_columns array<string>, dtype_changes array<string>, detected_at timestamp",
    "dataset_lineage_edges": "id bigint, edge_type string, from_dataset_id string, from_version int, "
    "to_dataset_id string, to_version int, from_run_id string, to_run_id string, to_model_id string, "
    "from_model_id string, created_at timestamp, note string",
    "prediction_requests": "request_id string, correlation_id string, model_id string, dataset string, "
    "input_type string, input_hash string, num_predictions int, status string, duration_ms double, error string, "
    "created_at timestamp",
    "predictions": "request_id string, row_index int, prediction string, probability string, created_at timestamp",
    "user_activity_logs": "user_id bigint, workspace_id bigint, action string, metadata_json string, "
    "created_at timestamp",
    "alert_events": "id bigint, workspace_id bigint, alert_type string, severity string, message string, "
    "metadata_json string, created_at timestamp",
    "schedules": "id bigint, workspace_id bigint, schedule_name string, schedule_type string, "
    "cron_expression string, timezone string, enabled boolean, next_run_at string, last_run_at string, "
    "pipeline_dataset string, pipeline_model_type string, created_at timestamp, updated_at timestamp",
    "schedule_runs": "schedule_id bigint, status string, started_at timestamp, completed_at timestamp, "
    "error string, metadata_json string",
}

# The keys that must be unique, and the references that must exist.
UNIQUE = {
    "experiments": [["run_id"]],
    "models": [["model_id"]],
    "drift_reports": [["report_id"]],
    "datasets": [["dataset_id"]],
    "dataset_versions": [["dataset_id", "version"], ["dataset_id", "hash"]],
    "dataset_schema_snapshots": [["dataset_version_id", "column_name"]],
    "dataset_schema_changes": [["dataset_id", "from_version", "to_version"]],
    "prediction_requests": [["request_id"]],
    "schedule_runs": [["schedule_id", "started_at"]],
}
FOREIGN = {
    "models": [("run_id", "experiments", "run_id")],
    "model_stage_events": [("model_id", "models", "model_id")],
    "predictions": [("request_id", "prediction_requests", "request_id")],
    "dataset_versions": [("dataset_id", "datasets", "dataset_id")],
    "schedule_runs": [("schedule_id", "schedules", "id")],
}

# One stage of a training run.
STAGES = "array<struct<name: string, status: string, duration: double>>"


def schema(table: str) -> T.StructType:
    """Schema of a registry table by name."""
    if table not in REGISTRY:
        raise ValueError(f"Unknown registry table: {table!r}")
    return _struct(REGISTRY[table])
