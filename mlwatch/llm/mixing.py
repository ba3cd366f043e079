"""Mixing sources to target weights: how often each document of a source goes into the mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.operators.frames import attach, gathered, settled, unused

WORD = r"[^\x20\x09-\x0D]+"


def word_count(df: DataFrame, text: str = "text", into: str = "size") -> DataFrame:
    """Add the number of words of each text; a null text has none."""
    return df.withColumn(into, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def source_sizes(df: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size): one settled row per source, the null source among them.

    Sizes are added up within tasks first, so that a source that holds most rows costs one row per task.
    """
    return settled(
        df.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size"))
    )


def cyclic_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Add ``weight``: 1, 2, ... ``cycle``, repeating, in order of the source by code point with null last.

    Ranks come from a range partitioning: the place within a partition plus the rows of the partitions before it. What follows
    has tasks for the sources there are.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        sizes.repartitionByRange(parts, F.col("source").isNull(), F.col("source"))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())))
    )
    placed = settled(gathered(placed, sizes.count()))
    before = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_n", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition: as bounded as the number of tasks
    return (
        placed.join(F.broadcast(before), "_part")
        .withColumn("weight", ((F.col("_place") - 1 + F.col("_n")) % cycle + 1).cast("double"))
        .select(*sizes.columns, "weight")
    )


def targets(weighted: DataFrame, cap: float = 3.0) -> DataFrame:
    """Add ``target``: the sources' shares of the total size by weight, none above ``cap`` times its own size.

    What a capped source can't take is shared by weight among the others. All uncapped sources then lie at one level
    times their weight, so each round needs two sums only: the total still to share, and the weights that share it.
    A source of size 0 has target 0. ``weight`` must be above 0.
    """
    rows = settled(weighted.withColumn("_cap", F.col("source_size") * F.lit(cap)))
    total, level = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0
    while total:
        full = F.col("_cap") < F.col("weight") * F.lit(level)
        taken, free = rows.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (total - (taken or 0.0)) / free
        if raised <= level:
            break
        level = raised
    return rows.withColumn("target", F.least("_cap", F.col("weight") * F.lit(level))).drop("_cap")


def copies(docs: DataFrame, weighted: DataFrame, cap: float = 3.0, key: str = "doc_id", source: str = "source",
           size: str = "size", seed: str = "mix") -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies``, the number of times the mix takes each document.

    ``docs`` has sizes in whole numbers; ``weighted`` has source, source_size and weight. The source's rate is target
    over size. A document is taken floor(rate) times, and once more if its hashed key, read as a fraction, is below the
    rest. The hash depends on the seed and the key alone: runs agree, and rows of one key share their fate. Sources
    missing in ``weighted`` are not taken. A size of 0 counts as any other document of its source. Null sources are one;
    repeated rows share their fate; an empty table stays empty; columns that have the names of new ones are replaced.
    """
    docs = docs.drop("source_size", "target", "copies")
    named, plan = unused(docs, "_source", "_plan")
    planned = settled(targets(weighted, cap).select(F.col("source").alias(named), "source_size", "target"))
    out = attach(docs.withColumn(named, F.col(source)), planned, [named], plan)
    mine = {c: F.col(plan).getField(c) for c in ("source_size", "target")}
    rate = F.coalesce(F.when(mine["source_size"] > 0, mine["target"] / mine["source_size"]), F.lit(0.0))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13)
    chance = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
    taken = (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")
    return out.withColumns({**mine, "copies": taken}).drop(named, plan)


def emit(planned: DataFrame, by: str = "copies") -> DataFrame:
    """Each row as many times as its number of copies says; rows with none go."""
    return planned.withColumn(by, F.explode(F.array_repeat(F.lit(0), F.col(by).cast("int")))).drop(by)
