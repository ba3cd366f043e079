"""Classifying log and alert text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exception types and message keywords per error category, tried in this order.
ERROR_TYPES = (
    ("validation_error", ("ValueError", "KeyError", "TypeError")),
    ("configuration_error", ("FileNotFoundError", "PermissionError")),
)
ERROR_KEYWORDS = (
    ("database_error", ("database", "sql", "connection")),
    ("model_error", ("model", "artifact", "joblib")),
    ("pipeline_error", ("pipeline", "stage")),
    ("drift_error", ("drift", "psi", "kolmogorov")),
    ("authentication_error", ("auth", "login", "credential")),
    ("authorization_error", ("unauthorized", "forbidden", "permission")),
    ("external_service_error", ("mlflow", "external")),
)
ERROR_OTHER = "internal_error"

# Severity names per alert level.
ALERT_LEVELS = (("error", ("critical", "error")), ("warning", ("warning", "warn")))


def error_category(error_type: Column, message: Column) -> Column:
    """Category of an error: by exception type first, then by the first keyword group found in the message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(ERROR_OTHER)
    for name, words in reversed(ERROR_KEYWORDS):
        found = text.contains(words[0])
        for w in words[1:]:
            found = found | text.contains(w)
        out = F.when(found, name).otherwise(out)
    for name, types in reversed(ERROR_TYPES):
        out = F.when(error_type.isin(*types), name).otherwise(out)
    return out


def alert_level(severity: Column) -> Column:
    """error, warning or info for any spelling of a severity."""
    sev = F.lower(F.trim(severity))
    out = F.lit("info")
    for level, names in reversed(ALERT_LEVELS):
        out = F.when(sev.isin(*names), level).otherwise(out)
    return out
