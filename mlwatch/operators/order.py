"""Order statistics without putting a group into one task.

Running sums, ranks and quantiles need a total order, and a plain window over (feature) or (key) sorts each group
in a single task. The helpers here cut the order into pieces by a rule that is a function of the ordering value, work
inside the pieces in parallel, and combine one summary row per piece. Ties never straddle a cut, results are exact,
and the cuts only decide how the work is spread.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.functions.columns import clean, quoted
from mlwatch.operators.frames import attach, grouped, key_of, settled, within_broadcast
from mlwatch.operators.narrowing import ROUNDS, SPLITS, TASK_VALUES, bucket_of, looked_up, split

# ---------------------------------------------------------------------------------------------------------------
# Value buckets


def bucket_count(spark: SparkSession, at_least: int = 256) -> int:
    """A power of two no smaller than the session's shuffle parallelism."""
    want = max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return 1 << (want - 1).bit_length()


def bucketed(counts: DataFrame, stats: DataFrame, by: Sequence[str], value: str, buckets: int) -> DataFrame:
    """Rows with the statistics of their group and their ``bucket``; ``stats`` is settled and holds ``edges``."""
    extra = [c for c in stats.columns if c not in by and c != "edges"]
    out = attach(counts, stats, by)
    return out.withColumn("bucket", bucket_of(value, "_s.edges", buckets)).select(
        *counts.columns, *[F.col(f"_s.{c}").alias(c) for c in extra], "bucket"
    )


# ---------------------------------------------------------------------------------------------------------------
# Exact quantiles


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 20_000,
    most: int = TASK_VALUES,
) -> DataFrame:
    """Linearly interpolated quantiles: one row per group with ``c{i}_n`` and an array ``c{i}_q`` per column.

    Two passes over the rows. A sketch gives two cut points close around every probability. Then values between a pair
    are counted one by one, and all others by the cut points that they lie between; so little is shuffled, and every rank
    is known to lie at a value or between two cut points. Where more than ``most`` values lie there, the interval is cut
    again and again, and only the part that holds a wanted rank is looked into, so that no task sorts more. Should the
    sketch be wrong by more than it promises, wider pairs are tried. It decides how little moves, never the result.
    """
    probs = list(probs)
    width = 2.0 / accuracy
    marks = sorted({min(1.0, max(0.0, p + s * width)) for p in probs for s in (-1, 1)})
    m, cs = len(marks), range(len(cols))
    pairs = [tuple(marks.index(min(1.0, max(0.0, p + s * width))) for s in (-1, 1)) for p in probs]

    slim = df.select(*[F.col(quoted(k)) for k in by], *[clean(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    at_marks = ", ".join(f"{x!r}D" for x in marks)
    sketch = settled(
        grouped(slim, by).agg(
            *[F.expr(f"count(v{i}) AS c{i}_n") for i in cs],
            *[F.expr(f"percentile_approx(v{i}, array({at_marks}), {max(100, accuracy)}) AS c{i}_e") for i in cs],
        )
    )

    # One row per cell first, so that the comparisons stand once in the compiled code, not once for each column: a method of all
    # of them is beyond the size that the virtual machine compiles.
    place = " + ".join(f"int(v > _marks[{j}]) + int(v >= _marks[{j}])" for j in range(m))
    kept = " OR ".join(f"(v >= _marks[{a}] AND v <= _marks[{b}])" for a, b in pairs)
    wide = ", ".join(f"named_struct('ci', {i}, 'v', v{i}, '_marks', _s.c{i}_e)" for i in cs)
    cells = attach(slim, sketch, by).select(*by, F.expr(f"inline(array({wide}))")).where("v IS NOT NULL")
    # 2j between two cut points, odd or in steps of two at one; and the value itself if between a pair
    cells = cells.select(*by, "ci", F.expr(f"CAST({place} AS BIGINT) AS slot"), F.expr(f"IF({kept}, v, NULL) AS v"))
    keys = [*by, "ci"]
    near = settled(cells.groupBy(*keys, "slot", "v").agg(F.count("*").alias("k")))
    sizes = [F.expr(f"named_struct('ci', {i}, 'n', c{i}_n)") for i in cs]
    ranks = ", ".join(f"named_struct('pi', {pi}, 'side', {side}, 'rank', CAST({fn}((n - 1) * {p!r}D) AS BIGINT) + 1)" for pi, p in enumerate(probs) for side, fn in enumerate(("floor", "ceil")))
    wanted = sketch.select(*by, F.inline(F.array(*sizes))).where("n > 0").select(*keys, F.expr(f"inline(array({ranks}))"))
    picked = _at_ranks(near, wanted, keys, most)
    if picked is None:
        return exact_quantiles(df, cols, probs, by, max(1, accuracy // 10), most)
    wide = grouped(picked, by).agg(
        *[
            F.expr(f"max(CASE WHEN ci = {i} AND pi = {pi} AND side = {side} THEN v END) AS x{i}_{pi}_{side}")
            for i in cs
            for pi in range(len(probs))
            for side in (0, 1)
        ]
    )

    def interpolate(i: int, pi: int, p: float) -> str:
        pos = f"((c{i}_n - 1) * {p!r}D)"
        x = f"_s.x{i}_{pi}"
        return f"{x}_0 + ({x}_1 - {x}_0) * ({pos} - floor({pos}))"

    return settled(
        attach(sketch, settled(wide), by).select(
            *by,
            *[f"c{i}_n" for i in cs],
            *[F.expr(f"array({', '.join(interpolate(i, pi, p) for pi, p in enumerate(probs))}) AS c{i}_q") for i in cs],
        )
    )


def _at_ranks(near: DataFrame, wanted: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """``wanted`` (keys, pi, side, rank) with the value ``v`` at each rank; None if a rank lies where values were not kept.

    ``near``, settled, has (keys, slot, v, k): how often a value stands in a slot, or with a null how many values do that
    were not kept. Slots are in the order of values. A slot that holds a wanted rank and more than ``most`` values is cut
    in parts, which are the slots of the next round.
    """
    spans = near.groupBy(*keys, "slot").agg(
        F.sum("k").alias("k"), F.count("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    below = F.lit(0).cast("bigint")
    done, rows = None, near
    for round_ in range(ROUNDS):
        parent = [] if round_ == 0 else ["parent"]
        earlier = W.partitionBy(*keys, *parent).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
        spans = settled(spans.withColumn("below", F.coalesce(F.sum("k").over(earlier), F.lit(0)) + below))
        # one row per slot, and a few ranks per group
        hits = looked_up(spans, settled(wanted.groupBy(*keys).agg(F.collect_list(F.struct("pi", "side", "rank")).alias("asked"))), keys)
        hits = hits.select(*keys, "slot", "k", "m", "lo", "hi", "below", F.expr("inline(filter(asked, a -> a.rank > below AND a.rank <= below + k))"))
        hits = settled(hits)
        lost, widest = hits.agg(F.count_if(F.col("m") == 0), F.coalesce(F.max("m"), F.lit(0))).first()
        if lost:
            return None
        found = hits.where("lo = hi").select(*keys, "pi", "side", F.col("lo").alias("v"))
        done = found if done is None else done.union(found)
        open_ = settled(hits.where("lo < hi").select(*keys, "slot", "lo", "hi", "below").distinct())
        inside = looked_up(rows.where("v IS NOT NULL").select(*keys, "slot", "v", "k"), open_, [*keys, "slot"])
        if widest <= most or round_ == ROUNDS - 1:
            break
        wanted = hits.where("lo < hi").select(*keys, "pi", "side", "rank")
        cut = split(inside.withColumnRenamed("below", "start"), [*keys, "slot"], "v")
        rows = settled(cut.select(*keys, F.col("slot").alias("parent"), F.expr(f"slot * {SPLITS} + part").alias("slot"), "v", "k", "start"))
        below = F.col("start")
        spans = rows.groupBy(*keys, "parent", "slot").agg(
            F.sum("k").alias("k"), F.count("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.any_value("start").alias("start")
        )
    upto = W.partitionBy(*keys, "slot").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    summed = inside.withColumn("upto", F.col("below") + F.sum("k").over(upto)).select(*keys, "slot", "v", "k", "upto")
    asked = hits.where("lo < hi").groupBy(*keys, "slot").agg(F.collect_list(F.struct("pi", "side", "rank")).alias("asked"))
    ranked = looked_up(summed, settled(asked), [*keys, "slot"])
    ranked = ranked.select(*keys, "v", F.expr("inline(filter(asked, a -> a.rank <= upto AND a.rank > upto - k))"))
    return done.union(ranked.select(*keys, "pi", "side", "v"))


def approx_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Same shape as ``exact_quantiles`` from one sketch pass; each rank is off by at most n / accuracy."""
    aggs = []
    for i, c in enumerate(cols):
        v = clean(df, c)
        aggs += [
            F.count(v).alias(f"c{i}_n"),
            F.percentile_approx(v, list(probs), accuracy).cast("array<double>").alias(f"c{i}_q"),
        ]
    return settled(grouped(df, by).agg(*aggs))


# ---------------------------------------------------------------------------------------------------------------
# Ranks by hash: picking the first k rows of a random but repeatable order


def row_digest(keys: Sequence[str], seed: int) -> Column:
    """Hex digest that puts the rows of a frame into a repeatable random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(quoted(k)).cast("string") for k in keys]))


def digest_cuts(
    df: DataFrame,
    digest: Column,
    group: Column,
    quotas: Callable[[DataFrame], DataFrame],
    n_cuts: int,
    prefix: int = 4,
) -> DataFrame:
    """For each group, the digests that end its first, second, ... quota of rows in digest order.

    ``quotas`` turns the group sizes (``grp``, ``n``) into ``grp``, ``upto``: an array of ``n_cuts`` running row
    counts. Digests are uniform, so counting rows per leading hex digits finds the small bucket that holds each
    wanted rank, and only those buckets are sorted; the frame itself is never shuffled. A quota of zero gives a
    null cut. Groups must be few: callers bound them.
    """
    keyed = df.select(group.alias("grp"), digest.alias("dig"))
    heads = settled(keyed.groupBy("grp", F.substring("dig", 1, prefix).alias("head")).agg(F.count("*").alias("k")))
    w = W.partitionBy("grp").orderBy("head")
    runs = heads.withColumn("upto_head", F.sum("k").over(w)).withColumn("before", F.col("upto_head") - F.col("k"))
    sizes = heads.groupBy("grp").agg(F.sum("k").alias("n"))
    asked = quotas(sizes).select(key_of(["grp"]).alias("_key"), F.posexplode("upto").alias("cut", "rank"))
    spots = (
        runs.withColumn("_key", key_of(["grp"]))
        .join(asked, "_key")
        .where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto_head")))
        .groupBy("grp", "head", "before")
        .agg(F.collect_list(F.struct("cut", "rank")).alias("cuts"))
    )
    near = attach(keyed.withColumn("head", F.substring("dig", 1, prefix)), settled(spots), ["grp", "head"])
    near = near.where(F.col("_s").isNotNull()).select("grp", "head", "dig", "_s.*")
    in_head = W.partitionBy("grp", "head").orderBy("dig")
    ranked = near.withColumn("rk", F.col("before") + F.row_number().over(in_head))
    found = ranked.select("grp", "dig", "rk", F.inline("cuts")).where("rk = rank")
    cuts = found.groupBy("grp").agg(
        *[F.max(F.when(F.col("cut") == i, F.col("dig"))).alias(f"cut{i}") for i in range(n_cuts)]
    )
    return settled(cuts)


# ---------------------------------------------------------------------------------------------------------------
# Scans along an order: ranks, sums, and previous and following values per key

# Rows of a group that one task takes, and how many of them a splitter is chosen from.
DEPTH = 1_000_000
SAMPLED = 32


def equi_depth(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str, depth: int = DEPTH) -> DataFrame | None:
    """Rows with a piece number ``into`` that does not decrease along ``order`` and gives pieces of some ``depth`` rows in each
    group of ``keys``; None if no group has more rows than that.

    Splitters are values of the whole order key, taken at even distances from a sample of each large group. They are chosen by a
    hash, so that they are the same whenever they are computed; equal keys are never parted. A group costs its splitters,
    a millionth of its rows, and a row of a group that is not large no search.
    """
    at = F.struct(*[F.col(quoted(c)) for c in order])
    named = df.select(key_of(keys).alias("_grp"), at.alias("_at"))
    large = settled(named.groupBy("_grp").agg(F.count("*").alias("_n")).where(F.col("_n") > depth))
    if large.isEmpty():
        return None
    chosen = F.pmod(F.xxhash64("_grp", "_at"), F.lit(max(1, depth // SAMPLED))) == 0
    sampled = looked_up(named.where(chosen), large, ["_grp"]).groupBy("_grp", "_at").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(W.partitionBy("_grp").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    cut = F.expr(f"_upto DIV {SAMPLED} > (_upto - _k) DIV {SAMPLED}")
    edges = sampled.withColumn("_upto", upto).where(cut).groupBy(F.col("_grp").alias("_key"))
    edges = settled(edges.agg(F.array_sort(F.collect_list("_at")).alias("_edges")))
    if within_broadcast(edges):
        edges = F.broadcast(edges)
    steps = ", ".join(f"{1 << k}L" for k in reversed(range(32)))
    search = f"aggregate(array({steps}), 0L, (p, s) -> IF(p + s <= size(_edges) AND _edges[CAST(p + s - 1 AS INT)] <= _at, p + s, p))"
    found = df.withColumns({"_key": key_of(keys), "_at": at}).join(edges, "_key", "left")
    return found.withColumn(into, F.expr(f"IF(_edges IS NULL, 0L, {search})")).drop("_key", "_at", "_edges")


def sliced_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    piece: Column | None = None,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    rank: str | None = None,
    depth: int = DEPTH,
) -> DataFrame:
    """Window functions over (keys, order) for groups too large to sort in one task.

    ``piece`` must not decrease along ``order`` and splits a group into pieces; without it, groups of more than ``depth`` rows
    are cut by splitters of their order. On the rows strictly before the current one, ``last`` adds, per name, the latest
    non-null value of an expression, and ``total`` the sum of an integer expression. ``following`` adds the value of an
    expression on the next row, and ``rank`` the 1-based row number. Windows run per (keys, piece); one summary row per piece,
    which reads only the columns it needs and is combined before its shuffle, carries values across.
    """
    last, total, following = dict(last or {}), dict(total or {}), dict(following or {})
    named = {**last, **total, **{n: F.struct(e.alias("v")) for n, e in following.items()}}
    base = df.withColumns({f"_v_{n}": e for n, e in named.items()})
    if piece is not None:
        pieced = base.withColumn("_piece", piece)
    else:
        pieced = equi_depth(base, keys, order, "_piece", depth)
    whole = pieced is None
    base = base.withColumn("_cell", key_of(keys)) if whole else pieced.withColumn("_cell", key_of([*keys, "_piece"])).drop("_piece")
    here = W.partitionBy("_cell").orderBy(*order)
    before = here.rowsBetween(W.unboundedPreceding, -1)
    new = {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(before) for n in last}
    new |= {f"_l_{n}": F.sum(f"_v_{n}").over(before) for n in total}
    new |= {f"_l_{n}": F.lead(f"_v_{n}").over(here) for n in following}
    if rank:
        new["_rn"] = F.row_number().over(here)
    out = base.withColumns(new)
    if not whole:
        out = out.join(_carried(base, keys, order, last, total, following), "_cell", "left")

    def joined(name: str) -> Column:
        return F.col(f"_l_{name}") if whole else F.coalesce(f"_l_{name}", f"_c_{name}")

    def added(own: str, carried: str) -> Column:
        own_ = F.coalesce(own, F.lit(0))
        return (own_ if whole else own_ + F.coalesce(carried, F.lit(0))).cast("bigint")

    out = out.withColumns(
        {
            **{n: joined(n) for n in last},
            **{n: added(f"_l_{n}", f"_c_{n}") for n in total},
            **{n: joined(n).getField("v") for n in following},
            **({rank: added("_rn", "_off")} if rank else {}),
        }
    )
    return out.drop("_cell", "_off", "_rn", *[f"{p}{n}" for n in named for p in ("_v_", "_l_", "_c_")])


def _carried(base: DataFrame, keys: Sequence[str], order: Sequence[str], last, total, following) -> DataFrame:
    """(_cell, _off, _c_...): per piece, what the group's earlier and next pieces hand over."""
    pos = F.struct(*order)
    cells = base.groupBy("_cell").agg(
        F.count("*").alias("_cnt"),
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), pos)).alias(f"_t_{n}") for n in last],
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in total],
        *[F.min_by(f"_v_{n}", pos).alias(f"_t_{n}") for n in following],
    )
    pieces = W.partitionBy(*[F.col("_cell").getField(k) for k in keys]).orderBy(F.col("_cell").getField("_piece"))
    earlier = pieces.rowsBetween(W.unboundedPreceding, -1)
    return cells.select(
        "_cell",
        F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)).alias("_off"),
        *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last],
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in total],
        *[F.lead(f"_t_{n}").over(pieces).alias(f"_c_{n}") for n in following],
    )
