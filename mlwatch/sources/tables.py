"""Named data sets, cached splits, stored drift references, reports and alert files."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from mlwatch.operators.split import split

READERS = ("parquet", "orc", "csv", "json")


def load(
    spark: SparkSession,
    path: str,
    name: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    catalog: Sequence[str] | None = None,
) -> DataFrame:
    """A data set by name; an unknown name is an error. Text formats need a schema, so that no pass infers one."""
    if catalog is not None and name not in catalog:
        raise ValueError(f"no data set is named {name!r}")
    if fmt not in READERS:
        raise ValueError(f"Unknown format: {fmt!r}")
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    try:
        return reader.load(f"{path}/{name}.{fmt}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"no data set is named {name!r}") from e
        raise


def stream_table(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """A Parquet data set as a file stream; the trailing wildcard accepts a single file as well as a folder."""
    return spark.readStream.schema(schema).parquet(f"{path}/{name}.parquet*")


def feature_key(key: str, test_size: float, seed: int) -> str:
    """Name of the cached split of a data set."""
    raw = f"{key}|{round(float(test_size), 4)}|{int(seed)}"
    return hashlib.sha1(raw.encode("utf-8")).hexdigest()[:16]


def cached_split(
    df: DataFrame,
    key: str,
    keys: Sequence[str],
    root: str,
    test_size: float = 0.2,
    seed: int = 42,
    stratify: str | None = None,
) -> DataFrame:
    """The split of a data set, computed and stored once per (data set, test size, seed) under ``root``."""
    spark = df.sparkSession
    path = f"{root}/{feature_key(key, test_size, seed)}"
    stored = _read_if_there(spark, path)
    if stored is None:
        split(df, keys, test_size, seed, stratify).write.mode("overwrite").partitionBy("split").parquet(path)
        stored = spark.read.parquet(path)
    return stored


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class DriftReference:
    """Reference samples, one Parquet partition per data set."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, dataset: str) -> str:
        return f"{self.root}/dataset={hashlib.sha1(dataset.encode('utf-8')).hexdigest()[:16]}"

    def get(self, dataset: str) -> DataFrame | None:
        return _read_if_there(self.spark, self._path(dataset))

    def refresh(self, dataset: str, df: DataFrame) -> DataFrame:
        """Replace the reference, as a promotion does."""
        df.write.mode("overwrite").parquet(self._path(dataset))
        return self.spark.read.parquet(self._path(dataset))

    def get_or_create(self, dataset: str, df: DataFrame) -> DataFrame:
        """The stored reference; on the first scan of a data set ``df`` (its training part) becomes it."""
        stored = self.get(dataset)
        return self.refresh(dataset, df) if stored is None else stored


def save_report(df: DataFrame, path: str, facts: Mapping[str, object] | None = None) -> None:
    """Append report rows; ``facts`` (report id, data set, time) become columns. Feature rows stay rows."""
    out = df.withColumns({k: F.lit(v) for k, v in (facts or {}).items()}) if facts else df
    out.write.mode("append").parquet(path)


def write_alerts(df: DataFrame, path: str) -> None:
    """Append alert rows as JSON lines."""
    df.write.mode("append").json(path)


def retain(df: DataFrame, ts: str, now, days: int = 30) -> DataFrame:
    """Rows not older than a number of days."""
    at = now if not isinstance(now, str) else F.lit(now).cast(df.schema[ts].dataType)
    return df.where(F.col(ts) >= at - F.expr(f"INTERVAL {int(days)} DAYS"))


def preview(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows of each split; tasks keep only ``n`` rows per split before the shuffle."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
