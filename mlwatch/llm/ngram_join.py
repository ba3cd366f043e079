"""Similarity join on word n-grams: prefix filters under several token orders, verified, and the components of the links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.llm.batches import grams, mixed, released, slices, text_bytes, words
from mlwatch.llm.bitmaps import Bitmap, bitmap
from mlwatch.llm.components import components
from mlwatch.operators.frames import gathered, settled, unused

K = 5
PERCENT = 75
BUFFER = 500_000
GROUP_TOKENS = 500_000
TOKEN_BITS = 48
SHARED = 32
STARS = 3
CENTRES = 3
TASK_PAIRS = 10_000
TASK_BYTES = 4 << 20
BITS = 512
ORDER_B, ORDER_C, CLASS = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x2B7E151628AED2A7), np.uint64(0x243F6A8885A308D3)
SURVIVOR = "cls long, n int, p int, centre double, tokens binary, by_b array<long>, by_c array<long>, rare array<long>, bits array<long>"


def token_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of every row, sorted; their number per row; the row's class. A token is a 48-bit hash of an n-gram.

    Rows have one class, a 63-bit number, if they have the same tokens. A row without a word has no token and class 0.
    """
    _, _, h, rows = words(raw, at)
    g, offsets = grams(h, rows, k)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(offsets))
    token = g >> np.uint64(64 - TOKEN_BITS)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    if len(token):
        keep = np.concatenate([[True], (token[1:] != token[:-1]) | (row[1:] != row[:-1])])
        token, row = token[keep], row[keep]
    n = np.bincount(row, minlength=len(rows) - 1)
    cls = np.zeros(len(n), np.uint64)
    np.add.at(cls, row, mixed(token ^ CLASS))
    cls = mixed(cls + n.astype(np.uint64)) >> np.uint64(1)
    return token, n, np.where(n > 0, cls, np.uint64(0)).astype(np.int64)


def six(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def packed(cls: np.ndarray, n: np.ndarray | None, tokens: np.ndarray, doc: np.ndarray, df: np.ndarray | None = None) -> bytes:
    """Tokens of several classes, grouped by class, in one value; ``doc`` is each token's place in ``cls``, ascending.

    Without sizes the last 48 bits of a class are its name.
    """
    used, count = np.unique(doc, return_counts=True)
    head = np.array([len(used), len(tokens)], np.int32).tobytes()
    names = six(cls[used]) if n is None else cls[used].astype("<i8").tobytes() + n[used].astype("<i4").tobytes()
    body = names + count.astype("<i4").tobytes() + six(tokens)
    return head + body + (b"" if df is None else df.astype("<i4").tobytes())


def unpacked(blobs: list[bytes], with_df: bool = False, with_n: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None]:
    """Class, size of the class's set, token and count of documents, one each per token."""
    cls, n, tokens, dfs = [], [], [], []
    for b in blobs:
        docs, size = np.frombuffer(b, np.int32, 2)
        at = 8 + (16 if with_n else 10) * docs
        count = np.frombuffer(b, "<i4", docs, at - 4 * docs)
        names = np.frombuffer(b, "<i8", docs, 8) if with_n else unsix(b[8 : 8 + 6 * docs]).astype(np.int64)
        cls.append(np.repeat(names, count))
        if with_n:
            n.append(np.repeat(np.frombuffer(b, "<i4", docs, 8 + 8 * docs), count))
        tokens.append(unsix(b[at : at + 6 * size]))
        if with_df:
            dfs.append(np.frombuffer(b, "<i4", size, at + 6 * size))
    return np.concatenate(cls), np.concatenate(n) if with_n else None, np.concatenate(tokens), np.concatenate(dfs) if with_df else None


def dealt(cls, n, tokens, doc, to, parts, df=None) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(to.astype(np.uint16 if parts < 65536 else np.int64), kind="stable")
    tokens, doc, to = tokens[order], doc[order], to[order]
    df = None if df is None else df[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True):
        if b > a:
            yield int(to[a]), packed(cls, n, tokens[a:b], doc[a:b], None if df is None else df[a:b])


def rows_with_class(df: DataFrame, text: str, k: int, names: tuple[str, str] = ("n_shingles", "cls")) -> DataFrame:
    """The rows with the size and the class of their sets."""
    schema = df.select("*", *[F.lit(0).cast("long").alias(c) for c in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            _, n, cls = token_sets(*text_bytes(b.column(text)), k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(cls)], [*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def posted(df: DataFrame, text: str, k: int, parts: int, chosen, with_n: bool) -> DataFrame:
    """(part, blob): what ``chosen`` leaves of the classes (class, size) and of their tokens, dealt by the tokens' values."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cls, n, tokens, times = (np.concatenate([h[i] for h in held]) for i in range(4))
            doc = np.repeat(np.arange(len(n)), times)
            to = (tokens >> np.uint64(16)) * np.uint64(parts) >> np.uint64(TOKEN_BITS - 16)
            for part, blob in dealt(cls, n if with_n else None, tokens, doc, to, parts):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])

        for b in slices(batches, "text"):
            tokens, n, cls = token_sets(*text_bytes(b.column("text")), k)
            fresh = np.zeros(len(n), bool)
            for i, c in enumerate(cls.tolist()):
                if c not in seen and n[i]:
                    seen.add(c)
                    fresh[i] = True
            held.append(chosen(cls[fresh], n[fresh], tokens[np.repeat(fresh, n)]))
            size += len(held[-1][2])
            if size > BUFFER:
                yield from flush()
                held, size = [], 0
                seen = seen if len(seen) < 1_000_000 else set()
        if size:
            yield from flush()

    return df.select(F.col(text).alias("text")).mapInArrow(post, "part int, blob binary")


def shared_tokens(rows: pd.DataFrame, with_n: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Class, size of its set, token and number of different classes that have it, for the tokens of a group that several have."""
    cls, n, tokens, _ = unpacked(rows["blob"].tolist(), with_n=with_n)
    order = np.lexsort((cls, tokens))
    cls, tokens = cls[order], tokens[order]
    n = n[order] if with_n else None
    del order
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])])
    cls, tokens = cls[new], tokens[new]
    n = n[new] if with_n else None
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    times = np.diff(np.append(first, len(tokens)))
    df = np.repeat(times, times)
    return cls[df > 1], n[df > 1] if with_n else None, tokens[df > 1], df[df > 1]


def screened(df: DataFrame, rows: DataFrame, text: str, k: int, percent: int) -> tuple[Bitmap, float]:
    """The classes that can have a partner, by their first tokens alone, and their part of all tokens.

    A similar pair has ceil(percent of n) tokens in common, for the n of either; so of each one's first
    n - ceil(percent of n) + SHARED tokens by a hash SHARED are among the other's first ones. Classes whose ceil is below
    SHARED send all, and need that many. Classes with fewer tokens that others have sent too are left out, and no other.
    """
    need = F.expr(f"({percent} * n_shingles + 99) div 100")
    sent = rows.agg(F.sum(F.least("n_shingles", F.col("n_shingles") - need + SHARED)), F.sum("n_shingles")).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sent[0] or 0) // (2 * GROUP_TOKENS)))

    def first(cls: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        doc = np.repeat(np.arange(len(n)), n)
        tokens = tokens[np.lexsort((mixed(tokens ^ ORDER_B), doc))]
        least = -(-percent * n // 100)
        times = np.where(least < SHARED, n, n - least + SHARED)
        return cls, n, tokens[np.arange(len(tokens)) - (np.cumsum(n) - n)[doc] < times[doc]], times

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own, times = np.unique(shared_tokens(group, False)[0], return_counts=True)
        released()
        return pd.DataFrame({"name": own, "shared": times.astype(np.int32)})

    found = posted(df, text, k, parts, first, False).groupBy("part").applyInPandas(count, "name long, shared int")
    found = found.groupBy("name").agg(F.sum("shared").alias("shared"))
    sizes = rows.where("n_shingles > 0").select("cls", "n_shingles", F.col("cls").bitwiseAND(F.lit((1 << 48) - 1)).alias("name")).distinct()
    wanted = found.join(sizes, "name").where(F.col("shared") >= F.least(F.lit(SHARED), need)).select("cls", "n_shingles")
    wanted = settled(gathered(wanted, sent[0] or 0, GROUP_TOKENS))
    size = wanted.agg(F.sum("n_shingles")).first()[0] or 0
    return bitmap(wanted.select("cls")), size / max(1, sent[1] or 0)


def survivors(df: DataFrame, text: str, k: int, percent: int, wanted: Bitmap, share: float, parts: int) -> DataFrame:
    """Those of the wanted classes that may have a partner, with their shared tokens and prefixes.

    Tokens are dealt by their value, counted over different classes, and those of two or more go back to their classes.
    A class survives if it has shared tokens enough for a partner. Its prefix under an order is what is left of the first
    n - ceil(percent of n) + 1 tokens once the unshared ones, which come first in every order, are out. Orders: rare
    tokens first (``rare`` lists the prefix), and two by hashes of the token (``by_b`` and ``by_c``). Of ``parts`` groups, enough
    for all tokens, those are used that the ``share`` of the wanted classes needs. ``bits`` tells for BITS places whether an odd number of shared tokens falls there. Values between the steps hold the tokens of many documents, so that a token costs six bytes, not a row.
    """
    shared_, parts = df.sparkSession.sparkContext.broadcast(wanted), max(1, min(parts, math.ceil(parts * share)))

    def own(cls: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        has = shared_.value.has(cls)
        return cls[has], n[has], tokens[np.repeat(has, n)], n[has]

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cls, n, tokens, df = shared_tokens(rows, True)
        own, at, doc = np.unique(cls, return_index=True, return_inverse=True)
        order = np.argsort(doc, kind="stable")
        out = list(dealt(own, n[at], tokens[order], doc[order], (own % parts)[doc[order]], parts, df[order])) if len(own) else []
        released()
        return pd.DataFrame({"part": np.array([p for p, _ in out], np.int32), "blob": [b for _, b in out]})

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cls, n, tokens, df = unpacked(rows["blob"].tolist(), True)
        order = np.lexsort((tokens, cls))
        cls, n, tokens, df = cls[order], n[order], tokens[order], df[order]
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.empty(0, np.int64)
        last = np.append(first[1:], len(cls))
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            size, own, times = int(n[a]), tokens[a:b], df[a:b]
            need = -(-percent * size // 100)
            p = size - need + 1 - (size - len(own))
            if p < 1:
                continue
            by_b, by_c = (own[np.argpartition(mixed(own ^ salt), p - 1)[:p]].astype(np.int64) for salt in (ORDER_B, ORDER_C))
            rare = own[np.lexsort((mixed(own), times))[:p]]
            centre = (float(times.sum()) + size - len(own)) / size
            odd = np.bincount((mixed(own ^ CLASS) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
            bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
            out.append((cls[a], size, p, centre, six(own), by_b, by_c, rare.astype(np.int64), bits))
        released()
        return pd.DataFrame(out, columns=["cls", "n", "p", "centre", "tokens", "by_b", "by_c", "rare", "bits"])

    shared = posted(df, text, k, parts, own, True).groupBy("part").applyInPandas(count, "part int, blob binary")
    return shared.groupBy("part").applyInPandas(gather, SURVIVOR)


def in_pairs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``found`` whose classes are in settled pairs (a, b), and by chance some others."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    shared = found.sparkSession.sparkContext.broadcast(bitmap(settled(gathered(wanted, 2 * pairs.count()))))

    @F.pandas_udf("boolean")
    def has(cls: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(cls.to_numpy()))

    return found.where(has("cls"))


def sharing_prefixes(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that share prefix tokens under both hash orders too; only prefixes move."""
    side = found.select("cls", "by_b", "by_c")
    left = side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns])
    right = side.select(*[F.col(c).alias(f"b_{c}") for c in side.columns])
    joined = gathered(pairs.join(left, F.col("a") == F.col("a_cls")), pairs.count(), TASK_PAIRS).join(right, F.col("b") == F.col("b_cls"))
    return joined.where(F.arrays_overlap("a_by_b", "b_by_b") & F.arrays_overlap("a_by_c", "b_by_c")).select("a", "b")


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those of the settled pairs (a, b) that share prefix tokens under both hash orders too, and then are similar enough.

    Only classes in a pair send prefixes, and only those in a pair that shares them their token lists.
    """
    pairs = settled(gathered(sharing_prefixes(pairs, in_pairs(found, pairs)), pairs.count(), TASK_PAIRS))
    n = pairs.count()
    side = in_pairs(found, pairs).select("cls", "n", "tokens")
    left = side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns])
    right = side.select(*[F.col(c).alias(f"b_{c}") for c in side.columns])
    joined = gathered(gathered(pairs, n, TASK_PAIRS).join(right, F.col("b") == F.col("b_cls")), n, TASK_PAIRS).join(left, F.col("a") == F.col("a_cls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            keep = []
            last, x = None, None
            size_a, size_b = cols["a_n"].to_pylist(), cols["b_n"].to_pylist()
            for i, a in enumerate(cols["a"].to_pylist()):
                if a != last:
                    x, last = unsix(cols["a_tokens"][i].as_py()), a
                y = unsix(cols["b_tokens"][i].as_py())
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                if 100 * both >= percent * (size_a[i] + size_b[i] - both):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([cols["a"].take(pa.array(keep)), cols["b"].take(pa.array(keep))], ["a", "b"])

    slim = joined.select("a", "b", *[f"{s}_{c}" for s in "ab" for c in ("n", "tokens")])
    return gathered(slim, n, TASK_PAIRS).mapInArrow(run, "a long, b long")


def slack(percent: int) -> Column:
    """What a class's unshared tokens are above its part of those that a similar pair can have; similar classes' add up to 0 or less.

    Of a pair's tokens n at most (100 - percent) in (100 + percent) are in one of the sets only, and unshared ones are.
    """
    return (100 + percent) * (F.col("n") - F.expr("length(tokens) div 6")) - (100 - percent) * F.col("n").cast("long")


def may_be_close(percent: int) -> Column:
    """Whether two sets can be similar enough, by their sizes and by how many of their bits differ.

    Each token that only one of them has turns at most one bit, and unshared tokens are each in one of them only; so more
    of both than similar sets can have rules a pair out, and never a similar one.
    """
    turned = F.lit(0)
    for i in range(BITS // 64):
        turned = turned + F.bit_count(F.get("a_bits", F.lit(i)).bitwiseXOR(F.get("b_bits", F.lit(i))))
    allowed = F.expr(f"a_n + b_n - 2 * ((({percent} * (a_n + b_n)) + {99 + percent}) div {100 + percent})")
    return turned + F.col("a_free") + F.col("b_free") <= allowed


def class_roots(found: DataFrame, percent: int) -> DataFrame:
    """(node, root) for the classes that have a link, the root being the smallest class of their component.

    Classes meet where they share a token of the rare-first prefix. All pairs of a large family would be far too many, and
    its components need few of them: first the most central class at each token, whose tokens are the most common
    ones, is compared with the others there, each with the CENTRES most central ones that it meets, and again for tokens that
    still join several components. What is left
    is compared in full: at each token every class outside the token's largest component, with all of other components.
    At each token classes go, before any pair is made, whose ``slack`` is too large even for the one with the least there, and
    two with a positive slack are never paired. So no pair is left out but those already connected and those that ``slack`` or
    ``may_be_close`` rules out.
    """
    met = settled(found.select(F.explode("rare").alias("token"), "cls", "n", "centre", slack(percent).alias("slack")))
    n = met.count()
    met = gathered(met, n)
    edges, roots = None, None
    close = (F.col("a_n") * percent <= F.col("b_n") * 100) & (F.col("b_n") * percent <= F.col("a_n") * 100)
    for round_ in range(STARS + 1):
        if roots is None:
            at = met.withColumn("comp", F.col("cls"))
        else:
            at = gathered(met.join(roots, F.col("cls") == F.col("node"), "left"), n).withColumn("comp", F.coalesce("root", "cls")).drop("node", "root")
        sizes = gathered(at.groupBy("token", "comp").agg(F.count("*").alias("size"), F.min("slack").alias("least")), n)
        largest = sizes.groupBy("token").agg(F.max(F.struct("size", "comp"))["comp"].alias("major"), F.count("*").alias("comps"), F.min("least").alias("least")).where("comps > 1")
        largest = gathered(largest.select("token", "major", "least"), n)
        open_ = settled(gathered(at.join(largest, "token"), n).where("slack + least <= 0").drop("least"))
        n_open = open_.count()
        open_ = gathered(open_, n_open)
        if round_ == STARS:
            facts = found.select("cls", "bits", (F.col("n") - F.expr("length(tokens) div 6")).alias("free"))
            open_ = gathered(settled(gathered(open_.join(facts, "cls"), n_open)), n_open)
        minor = open_ if round_ == 0 else open_.where(F.col("comp") != F.col("major"))
        if round_ < STARS:
            best = minor.groupBy("token").agg(F.max(F.struct("centre", "cls", "n", "comp")).alias("x"))
            left = best.select("token", F.col("x.cls").alias("a"), F.col("x.n").alias("a_n"), F.col("x.comp").alias("a_comp"), F.col("x.centre").alias("centre"))
        else:
            left = minor.select("token", F.col("cls").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", "comp", "bits", "free", "slack")])
        right = open_.select("token", F.col("cls").alias("b"), *[F.col(c).alias(f"b_{c}") for c in open_.columns if c in ("n", "comp", "bits", "free", "slack")])
        near = close & may_be_close(percent) if round_ == STARS else close
        met_ = left.join(right, "token")
        if round_ == STARS:
            met_ = left.where("a_slack <= 0").join(right, "token").union(left.where("a_slack > 0").join(right.where("b_slack <= 0"), "token"))
        pairs = met_.where((F.col("a_comp") != F.col("b_comp")) & near)
        if round_ == STARS:
            pairs = pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
        else:
            # prefixes and token lists move once per pair: of the classes that a class meets, the most central will do
            centres = F.reverse(F.array_sort(F.collect_set(F.struct("centre", "a"))))
            pairs = gathered(pairs, n_open).groupBy("b").agg(F.slice(centres, 1, CENTRES).alias("near")).select("b", F.explode("near.a").alias("a"))
            pairs = gathered(pairs, n_open)
        pairs = settled(pairs)
        links = settled(verified(gathered(pairs, pairs.count()), found, percent))
        if round_ and links.isEmpty():
            if round_ == STARS:
                break
            continue
        edges = links if edges is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)
        roots = components(edges, edges.count())
    return roots


def class_components(df: DataFrame, rows: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """(cls, component_id, chosen) for the classes of settled ``rows`` (id, n_shingles, cls): the smallest id of the
    component, and whether the class is the one that stands for it, the smallest of those that have that id."""
    n_tokens = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // GROUP_TOKENS))
    wanted, share = screened(df, rows, text, k, percent)
    found = settled(gathered(survivors(df, text, k, percent, wanted, share, parts), int(n_tokens * share), GROUP_TOKENS))
    size = found.agg(F.sum(F.length("tokens") + 24 * F.col("p") + BITS // 8)).first()[0] or 0
    roots = class_roots(gathered(found, size, TASK_BYTES), percent)
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("least"))
    placed = classes.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "cls")).alias("best"))
    return placed.join(best, "root").select("cls", F.col("best.least").alias("component_id"), (F.col("cls") == F.col("best.cls")).alias("chosen"))


def similarity_components(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id), one row per row: size of its set, and the smallest id that links lead to.

    A row's set is the distinct runs of ``k`` words of its text, A-Z lower-cased, or the whole sequence of fewer words. Rows
    link when 100 times the sets' intersection is at least ``percent`` times their union. Null, empty and blank texts
    have an empty set and no link: their component is their own id. Equal sets are one class before anything is
    compared, so repeated rows and exact copies cost nothing. The smallest id of a component leaves out null ids; rows
    with null ids only have null. Tokens and classes are hashes of 48 and 63 bits.
    """
    own = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = settled(rows_with_class(own, "text", k).drop("text"))
    named = class_components(own, rows, "text", k, percent).drop("chosen")
    return rows.join(named, "cls", "left").select(
        F.col("id").alias(id), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def representatives(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` with one row of each component: one that has its smallest id. Rows with an empty set all stay.

    Of rows that repeat this id with equal sets one stays. Rows meet the chosen classes by class and id, so that the
    copies of a text, however many, do not meet in one task.
    """
    own = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = settled(rows_with_class(own, "text", k).drop("text"))
    chosen = class_components(own, rows, "text", k, percent).where("chosen")
    cls, n, key, stays, place = unused(df, "_cls", "_n", "_id", "_stays", "_place")
    chosen = chosen.select(F.col("cls").alias(cls), F.struct("component_id").alias(key), F.lit(True).alias(stays))
    keyed = rows_with_class(df, text, k, (n, cls)).withColumn(key, F.struct(F.col(id).alias("component_id")))
    joined = keyed.join(chosen, [cls, key], "left")
    nth = F.row_number().over(W.partitionBy(cls, key).orderBy(F.xxhash64(text)))
    return joined.withColumn(place, nth).where((F.col(n) == 0) | (F.col(stays) & (F.col(place) == 1))).select(*df.columns)
