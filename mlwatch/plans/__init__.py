"""Registered queries over the shared tables, and the SQL they must agree with."""

from mlwatch.plans import drift, models, quality, records, signals, streams
from mlwatch.plans.register import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "drift", "models", "quality", "records", "signals", "streams"]
