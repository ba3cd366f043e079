"""The stage log of the model registry from a stream of requests: a stored relation joins every batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlwatch.operators.frames import settled
from mlwatch.operators.order import DEPTH
from mlwatch.operators.registry import apply_transitions, current_stage

# Before every request: the time of what a batch is told of the ones before.
BEFORE = "0001-01-01 00:00:00"
LOG = "dataset string, model_id string, from_stage string, to_stage string, changed_at timestamp, event_id bigint, ord int, note string"
STATE = "dataset string, model_id string, stage string"


def stage_batch(batch: DataFrame, state: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """The log of a batch of requests (dataset, model_id, to_stage, changed_at, event_id), and the state after it.

    ``state`` (dataset, model_id, stage) is the stage each model has when the batch begins. It leads the batch as
    one request per model, at a time before all others, of which only what the batch changes is logged: the batch
    operator then sees the models promoted earlier and the stages left. Only models of data sets in the batch take part.
    """
    named = ("changed_at", "event_id")
    known = state.join(batch.select("dataset").distinct(), "dataset", "left_semi")
    told = known.select(
        "dataset", "model_id", F.col("stage").alias("to_stage"), F.lit(BEFORE).cast("timestamp").alias("changed_at"), F.lit(None).cast("bigint").alias("event_id")
    )
    log = settled(apply_transitions(told.unionByName(batch.select(*told.columns)), named, depth).where(F.col("event_id").isNotNull()))
    after = current_stage(log)
    return log, state.join(after, ["dataset", "model_id"], "left_anti").unionByName(after)


def stage_batch_writer(path: str, depth: int = DEPTH) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores the stage log of every micro-batch under ``path``, in the shared folder.

    The state after a batch has a folder of its own and leads the next one. A batch that is run again reads the state before
    it and replaces what it wrote. A request that arrives in a later batch is applied then.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(STATE).parquet(f"{path}/state/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], STATE)
        log, after = stage_batch(batch, state, depth)
        after.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        log.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    return write


def stream_transitions(requests: DataFrame, path: str, depth: int = DEPTH) -> DataFrame:
    """The stage event log of a stream of requests, with the micro-batch each event came from, once everything available is processed.

    A data set is not one task: each batch runs the batch operator on the requests and the stored state. ``path`` lies in the
    cluster's shared folder and holds log, state and progress.
    """
    query = (
        requests.writeStream.foreachBatch(stage_batch_writer(path, depth))
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return requests.sparkSession.read.schema(f"{LOG}, batch bigint").parquet(f"{path}/log")
