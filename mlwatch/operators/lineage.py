"""Data-set versions, schema snapshots and lineage edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlwatch.functions.columns import missing, quoted
from mlwatch.operators.frames import grouped
from mlwatch.operators.registry import check_limit, newest_first


def row_hash(cols: Sequence[str]) -> Column:
    """48 bits of a digest of the row as a decimal number.

    Every cell stands behind its length, and a null behind -1, so that no two different rows give the same text.
    """
    texts = [F.col(quoted(c)).cast("string") for c in cols]
    cells = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-1:")) for t in texts]
    return F.conv(F.substring(F.md5(F.concat(F.lit(""), *cells)), 1, 12), 16, 10).cast("decimal(20,0)")


def dataset_version(df: DataFrame, dataset_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Content fingerprint, size and missing cells of a table.

    The fingerprint adds up row digests, so it does not depend on row order or partitioning, sees repeated rows, and
    needs no shuffle of the data. The columns' names and order are part of it.
    """
    cols = [c for c in df.columns if c not in by]
    gaps = [F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]
    s = grouped(df, by).agg(
        F.count("*").alias("row_count"), F.sum(row_hash(cols).cast("decimal(28,0)")).alias("total"), *gaps
    )
    summary = F.to_json(F.struct(*[F.col(f"m{i}").alias(c) for i, c in enumerate(cols)]))
    return s.select(
        *by,
        F.lit(dataset_id).alias("dataset_id"),
        F.md5(
            F.concat_ws(
                "|",
                F.lit("".join(f"{len(c)}:{c}" for c in cols)),
                F.col("row_count").cast("string"),
                F.coalesce(F.col("total"), F.lit(0)).cast("string"),
            )
        ).alias("hash"),
        "row_count",
        F.lit(len(cols)).alias("column_count"),
        summary.alias("missing_values_summary"),
    )


def schema_snapshot(df: DataFrame, version_id: int | str) -> DataFrame:
    """(version, column, type) rows of a table's schema."""
    rows = [(str(version_id), f.name, f.dataType.simpleString()) for f in df.schema.fields]
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("dataset_version_id", "column_name", "dtype")]
    )
    return df.sparkSession.createDataFrame(rows, schema)


def schema_change(old: DataFrame, new: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Added and removed columns and changed types between two snapshots, for one data set or many at once."""
    a = old.select(*keys, "column_name", F.col("dtype").alias("old_type"))
    b = new.select(*keys, "column_name", F.col("dtype").alias("new_type"))
    both = a.join(b, [*keys, "column_name"], "full")
    name = F.col("column_name")
    changed = F.when(
        F.col("old_type") != F.col("new_type"), F.concat(name, F.lit(":"), "old_type", F.lit("->"), "new_type")
    )
    return grouped(both, keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("old_type").isNull(), name))).alias("added_columns"),
        F.sort_array(F.collect_list(F.when(F.col("new_type").isNull(), name))).alias("removed_columns"),
        F.sort_array(F.collect_list(changed)).alias("dtype_changes"),
    )


def versions(table: DataFrame, dataset_id: str, n: int = 50) -> DataFrame:
    """Version history of a data set, newest first."""
    return newest_first(table, ["version"], check_limit(n), F.col("dataset_id") == dataset_id)


def edges(table: DataFrame, edge_type: str | None = None, n: int = 100) -> DataFrame:
    """Lineage edges, newest first; an unknown type has none."""
    where = None if edge_type is None else F.col("edge_type") == edge_type
    return newest_first(table, ["created_at", "id"], check_limit(n), where)
