"""Small building blocks shared by the operators: statistics beside rows, and long forms of wide rows."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.functions.columns import clean, quoted

BROADCAST_BYTES = 32 * 1024 * 1024
TASK_ROWS = 50_000


def grouped(df: DataFrame, by: Sequence[str]):
    """``df.groupBy(by)``, or the whole frame as one group."""
    return df.groupBy(*by) if by else df.groupBy()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints.

    Where the session names none, a local master gets a temporary one; on a cluster that is an error, as executors
    would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="mlwatch-")


def settled(df: DataFrame) -> DataFrame:
    """A small statistics frame, computed once and written to the checkpoint folder.

    Later passes then read the same numbers: a sketch computed twice may differ in its last digits, and a plan that
    holds each pass once instead of once per consumer stays short.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def gathered(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """The same rows in as many partitions as ``rows`` of them need at ``task_rows`` each, and in no more than there are.

    A shuffle writes files for each task before it, however little these hold; so a small frame that many short steps
    pass through costs files for its size, not for the session's number of partitions.
    """
    return df.coalesce(max(1, -(-rows // task_rows)))


def within_broadcast(stats: DataFrame) -> bool:
    """Whether a settled frame is measured to be small enough to hand to every task."""
    size = stats.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores behind it that no column of the frame has it; case does not tell names apart."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def key_of(by: Sequence[str]) -> Column:
    """The grouping keys as one struct. Equality of structs is null-safe, so null groups find each other in joins."""
    return F.struct(*[F.col(quoted(k)) for k in by])


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = (), name: str = "_s") -> DataFrame:
    """Put a settled frame with one row per group beside every row of its group, as one struct column.

    Without keys the statistics are a single row of numbers per column. They become a constant, which the optimizer
    folds into the expressions that use it. With keys they are broadcast when their measured size allows it;
    otherwise Spark joins both sides on the keys and splits hot ones (adaptive skew join).
    """
    if not by:
        row = stats.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()
        return df.withColumn(name, F.from_json(F.lit(row[0]), stats.schema))
    (key,) = unused(df, "_key")
    packed = stats.select(key_of(by).alias(key), F.struct(*[c for c in stats.columns if c not in by]).alias(name))
    if within_broadcast(stats):
        packed = F.broadcast(packed)
    return df.withColumn(key, key_of(by)).join(packed, key, "left").drop(key)


def side_by_side(frames: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One-row-per-group frames zipped into one frame; the first one decides which groups there are."""
    out = frames[0]
    for k, f in enumerate(frames[1:]):
        cols = [c for c in f.columns if c not in by]
        if by:
            packed = f.select(key_of(by).alias("_key"), *cols)
            out = out.withColumn("_key", key_of(by)).join(packed, "_key", "left").drop("_key")
        else:
            out = out.withColumn(f"_f{k}", f.select(F.struct(*cols)).scalar()).select(*out.columns, f"_f{k}.*")
    return out


def melt_stats(stats: DataFrame, by: Sequence[str], cols: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """One row per group and feature from a wide statistics row.

    ``fields`` maps an output name to the suffix of the wide column: column ``i`` of ``cols`` holds its value in
    ``c{i}_{suffix}``.
    """
    rows = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"c{i}_{sfx}").alias(out) for out, sfx in fields.items()])
        for i, c in enumerate(cols)
    ]
    if not rows:
        raise ValueError("no columns to describe")
    return stats.select(*by, F.inline(F.array(*rows)))


def long_values(df: DataFrame, keep: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """(kept columns, feature, value) for every non-missing numeric cell."""
    slim = df.select(*keep, *[clean(df, c).alias(c) for c in cols])
    ids = [c for c in slim.columns if c not in cols]
    return slim.unpivot(ids, list(cols), "feature", "value").where(F.col("value").isNotNull())
