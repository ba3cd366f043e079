"""The prediction log: requests and their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlwatch.operators.registry import check_limit, newest_first, upsert


def prediction_rows(batches: DataFrame, predictions: str = "predictions", probabilities: str | None = None) -> DataFrame:
    """One row per prediction from request rows that hold them as arrays; value and probability as text."""
    prob = F.get(F.col(probabilities), F.col("row_index")) if probabilities else F.lit(None)
    kept = ["request_id", *([probabilities] if probabilities else [])]
    return batches.select(*kept, F.posexplode(predictions).alias("row_index", "_p")).select(
        "request_id",
        "row_index",
        F.col("_p").cast("string").alias("prediction"),
        prob.cast("string").alias("probability"),
    )


def log_requests(current: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert prediction requests by request id."""
    return upsert(current, new, ["request_id"], ["created_at"])


def history(requests: DataFrame, n: int = 50) -> DataFrame:
    """Newest requests; a limit outside 1..1000 is an error."""
    return newest_first(requests, ["created_at", "request_id"], check_limit(n))


def request_detail(requests: DataFrame, predictions: DataFrame, request_id: str | None = None) -> DataFrame:
    """Requests with their predictions, unsorted: ``row_index`` tells the order. A request without any keeps one row."""
    if request_id is not None:
        requests = requests.where(F.col("request_id") == request_id)
        predictions = predictions.where(F.col("request_id") == request_id)
    return requests.join(predictions, "request_id", "left")


def request_pages(
    requests: DataFrame, predictions: DataFrame, page_size: int = 1000, fields: Sequence[str] = ("prediction", "probability")
) -> DataFrame:
    """Requests with nested predictions, at most ``page_size`` per row, so that no array grows without bound."""
    paged = (
        predictions.withColumn("page", F.floor(F.col("row_index") / page_size).cast("bigint"))
        .groupBy("request_id", "page")
        .agg(F.sort_array(F.collect_list(F.struct("row_index", *fields))).alias("predictions"))
    )
    return requests.join(paged, "request_id", "left")
