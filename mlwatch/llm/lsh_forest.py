"""Near duplicates by a forest of sorted MinHash signatures, searched as deep as each region of it needs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.llm.batches import mixed, slices, text_bytes
from mlwatch.llm.bitmaps import bitmap
from mlwatch.llm.components import components
from mlwatch.llm.ngram_join import TASK_PAIRS, rows_with_class, six, token_sets, unsix
from mlwatch.operators.frames import TASK_ROWS, gathered, settled

K = 2
PERCENT = 80
TREES = 24
DEPTH = 3
VALUES = TREES * DEPTH
CHAINS = 4
CHAIN_DEPTH = 16
DEPTHS = (DEPTH, 4, 6, 8, 12, 18, 27, 40, VALUES)
MINOR = 1024
BLOCK = 1024
TASK_SETS = 8192
NEAREST = 8
ODD = 512
ODD_ROWS = 2048
MISS = 1e-6
LIMBS = VALUES // 24
FIT_SIGMAS = 5.5
TREE = np.uint64(0x9E3779B97F4A7C15)


def values_of(token: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """The least of every hash function over each row's tokens; rows without tokens are left out."""
    rng = np.random.default_rng(seed)
    salts, odds = (rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) for _ in range(2))
    begin = (np.cumsum(n) - n)[n > 0]
    out = np.empty((len(begin), VALUES), np.uint32)
    for k in range(VALUES):
        hashed = (((token ^ salts[k]) * (odds[k] * np.uint64(2) + np.uint64(1))) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(hashed, begin) if len(begin) else 0
    return out


def limbs_of(values: np.ndarray) -> np.ndarray:
    """Two bits of each value, 24 values to a number."""
    two = (values & np.uint32(3)).astype(np.int64).reshape(len(values), LIMBS, 24)
    return (two << (2 * np.arange(24))).sum(axis=2)


def odd_bits(token: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row whether an odd number of its tokens falls on each of ODD places, as bits; rows without tokens are left out."""
    n = n[n > 0]
    place = (mixed(token) % np.uint64(ODD)).astype(np.int64)
    ends, out = np.cumsum(n), []
    for i in range(0, len(n), ODD_ROWS):
        size = n[i : i + ODD_ROWS]
        own = place[ends[i] - n[i] : ends[min(i + ODD_ROWS, len(n)) - 1]]
        count = np.bincount(np.repeat(np.arange(len(size)), size) * ODD + own, minlength=len(size) * ODD)
        out.append(np.packbits((count & 1).astype(np.uint8)).reshape(len(size), ODD // 8))
    return np.concatenate(out) if out else np.empty((0, ODD // 8), np.uint8)


def sized(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """A settled frame in as many partitions as its rows need."""
    return gathered(df, df.count(), task_rows)


def signatures(df: DataFrame, text: str, k: int, seed: int) -> DataFrame:
    """(cls, n, signature, odd, limbs): one settled row for each different set of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text"):
            token, n, cls = token_sets(*text_bytes(b.column("text")), k)
            fresh = np.zeros(len(n), bool)
            for i, c in enumerate(cls.tolist()):
                if n[i] and c not in seen:
                    fresh[i] = True
                    seen.add(c)
            seen = seen if len(seen) < 1_000_000 else set()
            values = values_of(token[np.repeat(fresh, n)], n[fresh], seed)
            blobs = pa.array([v.tobytes() for v in values.astype(">u4")], pa.binary())
            limbs = limbs_of(values)
            odd = pa.array([x.tobytes() for x in odd_bits(token[np.repeat(fresh, n)], n[fresh])], pa.binary())
            columns = [pa.array(cls[fresh]), pa.array(n[fresh], pa.int32()), blobs, odd, *[pa.array(limbs[:, j]) for j in range(LIMBS)]]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "signature", "odd", *[f"limb{j}" for j in range(LIMBS)]])

    schema = "cls long, n int, signature binary, odd binary, " + ", ".join(f"limb{j} long" for j in range(LIMBS))
    return sized(settled(df.select(F.col(text).alias("text")).mapInArrow(run, schema).dropDuplicates(["cls"])), TASK_SETS)


def most_differing(percent: int) -> int:
    """How many values of similar sets differ in two bits at most; more do once in 5e7, FIT_SIGMAS standard deviations above the mean."""
    p = percent / 100 + (1 - percent / 100) / 4
    return math.ceil(VALUES * (1 - p) + FIT_SIGMAS * math.sqrt(VALUES * p * (1 - p)))


def alike(percent: int) -> Column:
    """Whether two sets may be similar enough: by their sizes, which rule out no similar pair, and by how many values agree in two bits."""
    both = (F.col("a_n") * percent <= F.col("b_n") * 100) & (F.col("b_n") * percent <= F.col("a_n") * 100)
    differ = F.lit(0)
    for j in range(LIMBS):
        x = F.col(f"a_limb{j}").bitwiseXOR(F.col(f"b_limb{j}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555_5555_5555)))
    return both & (differ <= most_differing(percent))


def sides(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those of the settled pairs (a, b) that may be similar."""
    n = pairs.count()
    facts = found.select("cls", "n", *[f"limb{j}" for j in range(LIMBS)])
    for side in "ab":
        pairs = gathered(pairs.join(facts.select(*[F.col(c).alias(f"{side}_{c}") for c in facts.columns]), F.col(side) == F.col(f"{side}_cls")), n)
    return pairs.where(alike(percent)).select("a", "b")


def confirmed(pairs: DataFrame, df: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """Those of the settled pairs (a, b) whose full sets are similar enough.

    Only texts of classes in a pair send their tokens, six bytes each, once.
    """
    n = pairs.count()
    pairs = gathered(pairs, n)
    wanted = settled(gathered(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), 2 * n))
    shared = df.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text"):
            token, n, cls = token_sets(*text_bytes(b.column("text")), k)
            own = np.flatnonzero(shared.value.has(cls) & (n > 0))
            begin, out = np.cumsum(n) - n, []
            for i in own.tolist():
                if int(cls[i]) not in seen:
                    seen.add(int(cls[i]))
                    out.append(i)
            seen = seen if len(seen) < 1_000_000 else set()
            if out:
                blobs = [six(token[begin[i] : begin[i] + n[i]]) for i in out]
                yield pa.RecordBatch.from_arrays([pa.array(cls[out]), pa.array(blobs, pa.binary())], ["cls", "tokens"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.empty(0, np.uint64)
        for b in batches:
            keep = []
            tokens_a, tokens_b = b.column("a_tokens"), b.column("b_tokens")
            for i, a in enumerate(b.column("a").to_pylist()):
                if a != last:
                    last, x = a, unsix(tokens_a[i].as_py())
                y = unsix(tokens_b[i].as_py())
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    tokens = df.select(F.col(text).alias("text")).mapInArrow(collect, "cls long, tokens binary").dropDuplicates(["cls"])
    right = tokens.select(F.col("cls").alias("b"), F.col("tokens").alias("b_tokens"))
    left = tokens.select(F.col("cls").alias("a"), F.col("tokens").alias("a_tokens"))
    both = gathered(gathered(pairs.join(right, "b"), n, TASK_PAIRS).join(left, "a"), n, TASK_PAIRS)
    return both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(verify, "a long, b long")


def chained(found: DataFrame, percent: int) -> DataFrame:
    """(a, b): neighbours in each of the first CHAINS sorted orders that share DEPTH values or more, and may be similar."""

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.frombuffer(b"".join(b.column("signature").to_pylist()), ">u4").reshape(-1, VALUES)
            for t in range(CHAINS):
                order = values[:, (t * DEPTH + np.arange(CHAIN_DEPTH)) % VALUES]
                yield pa.RecordBatch.from_arrays(
                    [b.column("cls"), pa.array(np.full(len(order), t, np.int32)), pa.array([o.tobytes() for o in np.ascontiguousarray(order)], pa.binary())], ["cls", "tree", "sorted"]
                )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, tree, order = np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, CHAIN_DEPTH), ">u4")
        for b in batches:
            own = np.frombuffer(b"".join(b.column("sorted").to_pylist()), ">u4").reshape(-1, CHAIN_DEPTH)
            cls, tree, order = (np.concatenate([x[-1:], y]) for x, y in ((cls, b.column("cls").to_numpy()), (tree, b.column("tree").to_numpy()), (order, own)))
            near = np.flatnonzero((tree[1:] == tree[:-1]) & (order[1:, :DEPTH] == order[:-1, :DEPTH]).all(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[near], cls[near + 1])), pa.array(np.maximum(cls[near], cls[near + 1]))], ["a", "b"])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select("cls", "signature").mapInArrow(orders, "cls long, tree int, sorted binary").repartitionByRange(parts, "tree", "sorted")
    return sides(sized(settled(dealt.sortWithinPartitions("tree", "sorted").mapInArrow(neighbours, "a long, b long").distinct())), found, percent)


def region_keys(rows: DataFrame, depth: int) -> DataFrame:
    """(tree, key, cls): the region of each class at a depth, for the trees that a row (cls, signature, trees) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.frombuffer(b"".join(b.column("signature").to_pylist()), ">u4").reshape(-1, VALUES).astype(np.uint64)
            lists = b.column("trees")
            row = np.repeat(np.arange(len(values)), lists.value_lengths().to_numpy())
            tree = lists.flatten().to_numpy()
            cls = b.column("cls").to_numpy()
            for t in np.unique(tree):
                own = row[tree == t]
                key = np.full(len(own), np.uint64(t) + np.uint64(1)) * TREE
                for j in range(depth):
                    key = mixed(key * TREE + values[own, (int(t) * DEPTH + j) % VALUES])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(key.view(np.int64)), pa.array(cls[own])], ["tree", "key", "cls"])

    return rows.select("cls", "signature", "trees").mapInArrow(run, "tree int, key long, cls long")


Region = tuple[np.ndarray, ...]


def met(left: Region, right: Region, percent: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of classes of different components that may be similar; the most alike of each left one if ``nearest``.

    A token that only one of two sets has turns one of the ODD bits at most, so that more bits than similar sets have such
    tokens rule a pair out, and never a similar one.
    """
    (_, comp, n, limbs, odd), (_, comp_, n_, limbs_, odd_) = left, right
    differ = np.zeros((len(comp), len(comp_)), np.uint8)
    for j in range(LIMBS):
        x = limbs[:, None, j] ^ limbs_[None, :, j]
        differ += np.bitwise_count((x | (x >> 1)) & 0x5555_5555_5555)
    fits = (comp[:, None] != comp_) & (n[:, None] * percent <= n_ * 100) & (n_ * percent <= n[:, None] * 100) & (differ <= most_differing(percent))
    x, y = np.nonzero(fits)
    both = n[x] + n_[y]
    own = both - 2 * -(-percent * both // (100 + percent))
    for i in range(0, len(x), ODD_ROWS):
        at = slice(i, i + ODD_ROWS)
        turned = np.bitwise_count(odd[x[at]] ^ odd_[y[at]]).sum(axis=1)
        fits[x[at], y[at]] = turned <= own[at]
    if not nearest:
        return np.nonzero(fits)
    best = np.where(fits, differ, 255).argmin(axis=1)
    some = np.flatnonzero(fits[np.arange(len(best)), best])
    return some, best[some]


def compared(regions: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b): candidates in regions (tree, key, cls, comp, n, limbs, major): classes outside a region's largest component with all others.

    Those outside come first and are held; the largest component passes by, a batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def pairs(left: Region, right: Region, out: list) -> None:
            for i in range(0, len(left[0]), BLOCK):
                block = tuple(x[i : i + BLOCK] for x in left)
                for j in range(0, len(right[0]), BLOCK):
                    other = tuple(x[j : j + BLOCK] for x in right)
                    x, y = met(block, other, percent, nearest)
                    out.append(np.stack([block[0][x], other[0][y]]))

        def closed(out: list) -> None:
            """The held classes with each other, once they are all known."""
            if len(held) > 1 or (held and len(held[0][0]) > 1):
                own = tuple(np.concatenate([h[k] for h in held]) for k in range(5))
                held[:] = [own]
                pairs(own, own, out)

        for b in batches:
            out: list[np.ndarray] = []
            tree, key, minor = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "key", "minor"))
            columns = (b.column("cls").to_numpy(), b.column("comp").to_numpy(), b.column("n").to_numpy().astype(np.int64), np.stack([b.column(f"limb{j}").to_numpy() for j in range(LIMBS)], axis=1),
                       np.frombuffer(b"".join(b.column("odd").to_pylist()), np.uint64).reshape(-1, ODD // 64))
            cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (key[1:] != key[:-1]) | (minor[1:] != minor[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tree)], strict=True):
                if i == j:
                    continue
                part = tuple(x[i:j] for x in columns)
                if (tree[i], key[i]) != (last[:2] if last else None):
                    if last and last[2]:
                        closed(out)
                    held = []
                elif last[2] and not minor[i]:
                    closed(out)
                if minor[i]:
                    held.append(part)
                else:
                    for own in held:
                        pairs(own, part, out)
                last = (tree[i], key[i], minor[i])
            if out:
                yield batch_of(np.concatenate(out, axis=1))
        out = []
        if last and last[2]:
            closed(out)
        if out:
            yield batch_of(np.concatenate(out, axis=1))

    def batch_of(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.max(axis=0)), pa.array(found.min(axis=0))], ["a", "b"])

    # dealt by a column of its own: Spark may leave out a repartition by columns that a join below has already dealt by, and then read
    # that join's input in another way that parts regions, as it does not know that the function needs them whole
    marked = regions.withColumn("minor", F.col("comp") != F.col("major")).withColumn("region", F.xxhash64("tree", "key"))
    return marked.repartition("region").sortWithinPartitions("region", "tree", "key", F.desc("minor")).mapInArrow(run, "a long, b long")


def searched(found: DataFrame, roots: DataFrame, missed: DataFrame, percent: int, trees: int = TREES, nearest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, missed) of one round: candidates (a, b) of different components, and what chance each class is left with to
    have missed a partner, as a logarithm.

    A region is the classes that share a prefix of a sorted order. It is compared where at most MINOR of its classes are
    outside its largest component: these with all of it, so that work grows with the classes alone. Others are
    searched one step deeper, in smaller regions, which may part similar classes; ``missed`` keeps account. Comparing is
    cheap, a few numbers of each, and only the pairs that pass it are sent on; with ``nearest`` one for each class.
    """
    chance = F.lit(percent / 100)
    facts = found.join(roots, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "cls"))
    facts = sized(settled(gathered(facts, found.count()).select("cls", "comp", "n", "odd", *[f"limb{j}" for j in range(LIMBS)])))
    open_ = missed.where(F.col("missed") > math.log(MISS)).select(F.col("cls").alias("needed"))
    rows = found.select("cls", "signature", F.array(*[F.lit(t) for t in range(trees)]).alias("trees"))
    pairs, closed = None, []
    for step, depth in enumerate(DEPTHS):
        at = settled(region_keys(rows, depth).join(facts.select("cls", "comp"), "cls"))
        n = at.count()
        at = gathered(at, n)
        marked = gathered(at.join(open_, F.col("cls") == F.col("needed"), "left"), n)
        sizes = gathered(marked.groupBy("tree", "key", "comp").agg(F.count("*").alias("size"), F.count("needed").alias("needed")), n)
        regions = sizes.groupBy("tree", "key").agg(
            F.sum("size").alias("size"), F.max(F.struct("size", "comp")).alias("major"), F.count("*").alias("comps"), F.sum("needed").alias("needed")
        )
        shared = regions.where("comps > 1 and needed > 0").select("tree", "key", F.col("major.comp").alias("major"), (F.col("size") - F.col("major.size")).alias("minors"))
        shared = sized(settled(gathered(shared, n)))
        fits = F.lit(True) if depth == VALUES else F.col("minors") <= MINOR
        here = gathered(gathered(at.join(shared.where(fits), ["tree", "key"]), n).join(facts.drop("comp"), "cls"), n)
        own = gathered(settled(compared(here, percent, nearest)), n)
        pairs = own if pairs is None else pairs.union(own)
        deeper = gathered(at.join(shared.where(~fits), ["tree", "key"]), n).select("cls", "tree")
        if step:
            closed.append(gathered(at.join(shared.where(~fits), ["tree", "key"], "left_anti"), n).select("cls", F.log1p(-F.pow(chance, F.lit(depth))).alias("chance")))
        lists = sized(settled(gathered(deeper.groupBy("cls").agg(F.collect_list("tree").alias("trees")), n)))
        if lists.isEmpty():
            break
        if not step:
            first = F.log1p(-F.pow(chance, F.lit(DEPTH)))
            closed.append(lists.select("cls", (-F.size("trees") * first).alias("chance")))
        rows = sized(settled(gathered(found.select("cls", "signature").join(lists, "cls"), n)), TASK_SETS)
    pairs = sized(settled(pairs.distinct()))
    if nearest:
        return pairs, missed
    gained = found.select("cls", F.lit(trees * math.log1p(-((percent / 100) ** DEPTH))).alias("chance"))
    for more in closed:
        gained = gained.union(more)
    gained = gathered(gained.groupBy("cls").agg(F.sum("chance").alias("chance")), found.count())
    left_over = missed.join(gained, "cls").select("cls", (F.col("missed") + F.col("chance")).alias("missed"))
    return pairs, sized(settled(left_over))


def near_classes(df: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """(node, root): classes that have a link, with the smallest class of their component.

    Neighbours in a few sorted orders, then the most alike ones in the regions of a few trees, link most of every family with
    a few pairs of each class. Then all trees are searched for pairs that are not yet connected, with new hash
    functions round by round, until every class has missed a similar one with a chance of less than MISS.
    """
    found = signatures(df, text, k, 0)
    roots = components(confirmed(settled(chained(found, percent)), df, text, k, percent))
    missed = found.select("cls", F.lit(0.0).alias("missed"))

    def grown(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return roots
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(confirmed(pairs, df, text, k, percent)))

    roots = grown(searched(found, roots, missed, percent, NEAREST, True)[0])
    round_ = 0
    while True:
        pairs, missed = searched(found, roots, missed, percent)
        roots = grown(pairs)
        if missed.where(F.col("missed") > math.log(MISS)).isEmpty():
            return roots
        round_ += 1
        found = signatures(df, text, k, round_)


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row: the size of its set, the smallest id that links lead to, and whether it is that.

    A row's set is the distinct runs of ``k`` words of its text, A-Z lower-cased, or the whole sequence of fewer words. Rows link
    when 100 times the sets' intersection is at least ``percent`` times their union, which full sets confirm. Null, empty and
    blank texts have an empty set and no link: their component is their own id. Equal sets are one class from the start, so that
    repeated rows and exact copies cost nothing. The smallest id leaves out nulls; rows with null ids only have null. An empty
    table gives no rows; other columns are not read. A similar pair is never a candidate with a chance below MISS; tokens and classes are
    hashes of 48 and 63 bits.
    """
    own = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = settled(rows_with_class(own, "text", k).drop("text"))
    roots = near_classes(own, "text", k, percent)
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("least"))
    placed = classes.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = rows.join(named, "cls", "left").withColumn("component_id", component)
    return out.select(F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
