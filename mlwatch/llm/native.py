"""Small column helpers for operators that stay in Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, also where ``use`` needs it inside a loop over an array.

    The optimizer merges a column into the expressions that use it; inside a loop that would compute it once per element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def total(numbers: Column) -> Column:
    """Sum of an array of whole numbers."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1, and an empty array for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
