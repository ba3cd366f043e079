"""Choosing, cleaning and aligning columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns, in frame order. Booleans are not numeric."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def object_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the columns that hold text or nested values where a model expects numbers."""
    kinds = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def features(df: DataFrame, target: str) -> DataFrame:
    """The frame without its target column."""
    return df.drop(target)


def common_cols(ref: DataFrame, cur: DataFrame) -> list[str]:
    """Columns present on both sides, in the order of the reference."""
    have = set(cur.columns)
    return [c for c in ref.columns if c in have]


def align(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exactly the expected columns in the expected order; extra columns go, missing ones are an error."""
    have = set(df.columns)
    missing = [c for c in expected if c not in have]
    if missing:
        raise ValueError("columns that the model needs are absent: " + ", ".join(missing))
    return df.select(*[F.col(quoted(c)) for c in expected])


def backfill(df: DataFrame, sources: Mapping[str, Sequence[str]]) -> DataFrame:
    """Fill nulls of each column from the first of its sibling columns that has a value."""
    filled = {c: F.coalesce(F.col(c), *[F.col(s) for s in alts]) for c, alts in sources.items()}
    return df.withColumns(filled)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def clean_sql(df: DataFrame, name: str) -> str:
    """SQL of a numeric column as double, with NaN turned into null so that both count as missing."""
    cast = f"CAST({quoted(name)} AS DOUBLE)"
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return f"nanvl({cast}, CAST(NULL AS DOUBLE))" if floating else cast


def clean(df: DataFrame, name: str) -> Column:
    return F.expr(clean_sql(df, name))


def missing(df: DataFrame, name: str) -> Column:
    """True where a cell is null, or NaN in a floating column."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.expr(f"({quoted(name)} IS NULL OR isnan({quoted(name)}))")
    return F.expr(f"({quoted(name)} IS NULL)")


def vector_width(df: DataFrame, col: str) -> int:
    """The length that all vectors of a column share; different lengths are an error. Null vectors don't count."""
    size = F.when(F.col(quoted(col)).isNotNull(), F.size(quoted(col)))
    least, most = df.agg(F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"vectors of {col} have {least} to {most} values")
    return least or 0
