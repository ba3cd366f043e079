"""Labelled training rows, and models handed to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as the empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit(""))) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, text: str = "text") -> DataFrame:
    """(text, label) of at most ``most`` labelled ids for which ``learn`` holds, chosen by a hash of the id.

    ``docs`` and ``labels`` have ``doc_id``. Rows without an id or a label are left out; an id with several labels has
    the most frequent one, the larger of equals. Only ids and labels are chosen from; their number is bounded, so
    they are broadcast and no text moves. Repeated documents with a chosen id all count.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
        .groupBy("doc_id")
        .agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    own = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
