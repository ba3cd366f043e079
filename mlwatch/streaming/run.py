"""Driving a streaming query over everything that is available, with its output as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlwatch.operators.frames import shared_dir


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input and return what the query emitted, with the micro-batch it came from.

    Output and progress live in the cluster's shared folder. Every micro-batch writes its own folder and replaces it
    when it is run again, so a lost executor or a restarted driver leaves no row twice.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/progress")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{root}/out")


def last_emitted(out: DataFrame, keys: list[str]) -> DataFrame:
    """The newest state of each key in the output of an update-mode query."""
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    newest = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s"))
    return newest.select(*keys, "_s.*")
