"""Search in sorted values by counting: ranges are cut in bins, and only bins that can hold the answer are looked into.

Counting bins shuffles one row per task and bin. Values travel only from the bins that are still open in the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.operators.frames import settled, unused, within_broadcast

# Parts of the first round, and of an open part in each later one; a long holds a path of ROUNDS parts.
BINS = 1 << 12
SPLITS = 1 << 6
ROUNDS = 9
# Values that one task sorts at most, and the share of all values that may travel while parts can still be cut.
TASK_VALUES = 1_000_000
SHARE = 0.05


def edges_agg(value: str, buckets: int) -> Column:
    """Approximate equal-frequency cut points of a SQL expression (an aggregate)."""
    probs = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    return F.expr(f"percentile_approx({value}, array({probs}), {max(2_000, 20 * buckets)})")


def bucket_of(value: str, edges: str, buckets: int) -> Column:
    """How many of the ``buckets - 1`` cut points lie strictly below the value: a binary search, as SQL."""
    steps = ", ".join(str(1 << k) for k in reversed(range(buckets.bit_length() - 1)))
    found = f"aggregate(array({steps}), 0, (p, s) -> IF({edges}[p + s - 1] < {value}, p + s, p))"
    return F.expr(f"IF({edges} IS NULL, 0, {found})")


def split(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with ``part``: which of SPLITS about equally large parts of its (keys) group holds the value.

    Ties stay together; a part without ties has at most a fiftieth of its group.
    """
    edges = settled(rows.groupBy(*keys).agg(edges_agg(value, SPLITS).alias("edges")))
    return looked_up(rows, edges, keys).withColumn("part", bucket_of(value, "edges", SPLITS).cast("bigint")).drop("edges")


def bin_sql(value: str, lo: str, hi: str, bins: int) -> str:
    """Which of ``bins`` parts of lo..hi holds a value between them, never less for a larger value, as SQL.

    The ends have bins of their own and the rest is cut evenly. Where the width overflows, all but the ends share a bin.
    """
    inner = f"least({bins - 3}D, nanvl(({value} - {lo}) * ({bins - 2}D / ({hi} - {lo})), 0D))"
    return f"CAST(CASE WHEN {value} = {lo} THEN 0 WHEN {value} = {hi} THEN {bins - 1} ELSE 1 + floor({inner}) END AS BIGINT)"


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of the settled ``table`` of their keys, null-safe; rows without an entry leave."""
    (at,) = unused(rows, "_at")
    packed = table.select(F.struct(*keys).alias(at), *[c for c in table.columns if c not in keys])
    if within_broadcast(table):
        packed = F.broadcast(packed)
    return rows.withColumn(at, F.struct(*keys)).join(packed, at).drop(at)


def share(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0D)"


def gap(r: str, c: str) -> str:
    return f"abs({share(r, 'n_ref')} - {share(c, 'n_cur')})"


def largest_gap(cells: DataFrame, ranges: DataFrame, keys: Sequence[str], parts: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The largest difference of two cumulative shares, by branch and bound.

    ``cells`` has the keys, ``side`` (0 or 1) and ``value``; ``ranges``, settled, the keys, ``n_ref`` and ``n_cur`` (the
    sides' sizes), ``lo`` and ``hi``. Counts per part give the difference exactly where parts end, and how large it
    can be inside each: no larger than if one side's values of the part all came first. Only parts that could beat the
    best difference so far are cut again, until few values are left in them; these are sorted, part by part.

    Returns (keys, d); the counts (keys, *parts, r, c) of the first round, by the SQL expressions of ``parts`` by name; and the cells that travel.
    """
    named = list(parts)
    zero = F.lit(0).cast("bigint")
    level = ranges.select(*keys, zero.alias("slot"), "lo", "hi", "n_ref", "n_cur", zero.alias("r0"), zero.alias("c0"), F.lit(0.0).alias("d"))
    carried = ["n_ref", "n_cur", "r0", "c0", "d"]
    total = ranges.agg(F.sum(F.col("n_ref") + F.col("n_cur"))).first()[0] or 0
    rows, best, by_part = cells.withColumn("slot", zero), None, None
    for round_ in range(ROUNDS):
        here = looked_up(rows, level, [*keys, "slot"])
        if round_ == 0:
            here = here.withColumn("part", F.expr(bin_sql("value", "lo", "hi", BINS)))
        else:
            here = split(here.drop("lo", "hi"), [*keys, "slot"], "value")
        counted = here.groupBy(*keys, "slot", "part", *(named if round_ == 0 else ())).agg(
            F.count_if(F.col("side") == 0).alias("r"),
            F.count_if(F.col("side") == 1).alias("c"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            *[F.first(x).alias(x) for x in carried],
        )
        if round_ == 0 and named:
            counted = settled(counted)
            by_part = counted.groupBy(*keys, *named).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
            counted = counted.groupBy(*keys, "slot", "part").agg(
                *[F.sum(x).alias(x) for x in "rc"], F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.first(x).alias(x) for x in carried]
            )
        # one row per part: at most BINS in a window, and per group those of all open parts
        before = W.partitionBy(*keys, "slot").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        starts = {f"{x}0": F.coalesce(F.sum(x).over(before), F.lit(0)) + F.col(f"{x}0") for x in "rc"}
        placed = counted.withColumns(starts).withColumn("at_end", F.expr(gap("r0 + r", "c0 + c")))
        placed = placed.withColumn("d", F.greatest("d", F.max("at_end").over(W.partitionBy(*keys))))
        bound = F.expr(f"greatest({gap('r0 + r', 'c0')}, {gap('r0', 'c0 + c')})")
        placed = settled(placed.withColumn("open", (F.col("hi") > F.col("lo")) & (bound > F.col("d"))))
        found = placed.groupBy(*keys).agg(F.max("d").alias("d"))
        best = found if best is None else best.union(found)
        inner = F.expr(f"slot * {SPLITS} + part").alias("slot")
        level = placed.where("open").select(*keys, inner, "lo", "hi", *carried, (F.col("r") + F.col("c")).alias("k"))
        left, most = level.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
        level = level.drop("k")
        rows = here.select(*keys, "side", "value", inner)
        if left <= SHARE * total and most <= TASK_VALUES:
            break
    travel = looked_up(rows, level.drop("lo", "hi", "d"), [*keys, "slot"])
    values = travel.groupBy(*keys, "slot", "value").agg(
        F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"), *[F.first(x).alias(x) for x in carried[:-1]]
    )
    upto = W.partitionBy(*keys, "slot").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    sums = values.select(*keys, "n_ref", "n_cur", *[(F.sum(x).over(upto) + F.col(f"{x}0")).alias(x) for x in "rc"])
    inside = sums.groupBy(*keys).agg(F.max(F.expr(gap("r", "c"))).alias("d"))
    return best.union(inside).groupBy(*keys).agg(F.max("d").alias("d")), by_part, travel
