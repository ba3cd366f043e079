"""Removal of long byte strings that occur more than once, found in suffix order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.llm.batches import CODE, mixed, powers, slices, text_bytes
from mlwatch.llm.bitmaps import bitmap
from mlwatch.llm.suffix_sort import suffix_order
from mlwatch.operators.frames import settled, unused

SIZE = 200
GRAM = 32
CHUNK = 1_000_000
BUFFER = 400_000
TOGETHER = 4 << 20
HOT = 2_000_000
GROUP_BYTES = 64 << 20
GROUP_STARTS = 2_000_000
SEEN = 1 << 30
SEEN_KEYS = 1_000_000


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place of a byte string that has that many left."""
    n = len(raw)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(CODE[raw] * up[:n], out=total[1:])
    return mixed((total[size:] - total[:-size]) * down[: n - size + 1])


def sliding(x: np.ndarray, w: int, best: np.ufunc, worst: np.uint64) -> np.ndarray:
    """The best of every ``w`` neighbours: each window is the end of one block and the start of the next."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, worst, x.dtype)]).reshape(-1, w)
    ahead = best.accumulate(padded, axis=1).reshape(-1)
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(behind[:n], ahead[w - 1 : w - 1 + n])


def anchored(raw: np.ndarray, at: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of places at which strings of ``size`` bytes start that have one anchor: row, value, first place, count, own.

    The anchor is the least hash of the grams inside a string; it depends on the string alone, so equal strings have equal
    anchors. ``own`` says whether a row has the anchor's value at several places. Places count from the row's start.
    """
    w = size - gram + 1
    none = np.empty(0, np.int64)
    if len(raw) < size:
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    h = window_hashes(raw, gram)
    least = sliding(h, w, np.minimum, np.uint64(2**64 - 1))
    n = len(least)
    length = np.diff(at)
    room = np.maximum(length - size + 1, 0)
    valid = np.zeros(n + 1, np.int32)
    some = room > 0
    np.add.at(valid, at[:-1][some], 1)
    np.add.at(valid, at[:-1][some] + room[some], -1)
    valid = np.cumsum(valid[:-1]) > 0
    row = np.repeat(np.arange(len(length)), length)[:n]
    edge = np.ones(n, bool)
    edge[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, n))
    keep = valid[first]
    first, count = first[keep], count[keep]
    value, own_row = least[first], row[first]
    # places of anchors: grams that are the least of some string around them
    shown = np.concatenate([np.zeros(w - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(w - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(shown, w, np.maximum, np.uint64(0))[: len(h)] == h)
    chosen_row = np.searchsorted(at, chosen, "right") - 1
    order = np.lexsort((h[chosen], chosen_row))
    v, r = h[chosen][order], chosen_row[order]
    twice = np.zeros(len(v), bool)
    twice[1:] = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    again = np.unique(np.stack([r[twice].astype(np.uint64), v[twice]]), axis=1)
    marked = mixed(again[1] ^ mixed(again[0])) if again.size else np.empty(0, np.uint64)
    own = np.isin(mixed(value ^ mixed(own_row.astype(np.uint64))), marked)
    return own_row, value, first - at[own_row], count, own


def pack(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(c.astype(t).tobytes() for c, t in zip(columns, ("<i8", "<u8", "<i4", "<i4"), strict=True))


def unpack(blobs: list[bytes]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[], [], [], []]
    for b in blobs:
        n = int(np.frombuffer(b, np.int64, 1)[0])
        at = 8
        for column, (kind, width) in zip(out, (("<i8", 8), ("<u8", 8), ("<i4", 4), ("<i4", 4)), strict=True):
            column.append(np.frombuffer(b, kind, n, at))
            at += n * width
    return [np.concatenate(c) for c in out]


def dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True):
        if b > a:
            yield int(to[a]), pack(*[c[order[a:b]] for c in columns])


def posts(key: np.ndarray, value: np.ndarray, first: np.ndarray, count: np.ndarray, own: np.ndarray, parts: int, runs: bool = False) -> Iterator[tuple[int, bytes]]:
    """Rows by the group that counts them, packed. Values that occur again among these rows, or that are ``own``, are settled:
    their rows go to groups from ``parts`` on, dealt by key, and one row a value, marked as seen, is counted with the others.

    So a group gets a value once from each lot, however often it occurs. Values are mixed first: the least of many
    hashes is a small number. ``runs`` joins settled places of a key that follow each other.
    """
    order = np.argsort(value, kind="stable")
    v = value[order]
    again = own[order]
    same = v[1:] == v[:-1]
    again[1:] |= same
    again[:-1] |= same
    head = again & np.concatenate([[True], ~same])
    counted, seen, settled_ = order[~again], order[head], order[again]
    to = np.concatenate([counted, seen])
    part = ((mixed(value[to]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    yield from dealt(part, key[to], value[to], first[to], np.concatenate([count[counted], count[seen] | SEEN]))
    key, value, first, count = key[settled_], value[settled_], first[settled_], count[settled_]
    if runs and len(key):
        order = np.lexsort((first, key))
        key, value, first = key[order], value[order], first[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (first[1:] > first[:-1] + 1)])
        last = np.append(np.flatnonzero(new)[1:], len(key)) - 1
        key, value, count, first = key[new], value[new], first[last] - first[new] + 1, first[new]
    yield from dealt(parts + key % parts, key, value, first, count)


def occurring_again(posted: DataFrame, parts: int) -> DataFrame:
    """(key, blob): the posted rows whose value occurs again."""

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        doc, value, first, times = unpack(rows["blob"].tolist())
        if key[0] < parts:
            order = np.argsort(value, kind="stable")
            v = value[order]
            again = np.zeros(len(v), bool)
            same = v[1:] == v[:-1]
            again[1:] |= same
            again[:-1] |= same
            order = order[again & (times[order] < SEEN)]
            doc, value, first, times = doc[order], value[order], first[order], times[order]
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        out = [(doc[a], pack(doc[a:b], value[order[a:b]], first[order[a:b]], times[order[a:b]])) for a, b in zip([0, *cuts], [*cuts, len(doc)], strict=True) if b > a]
        return pd.DataFrame({"key": np.array([k for k, _ in out], np.int64), "blob": [b for _, b in out]})

    return posted.groupBy("part").applyInPandas(count, "key long, blob binary")


def lots(rows: Iterator[tuple], parts: int, runs: bool = False) -> Iterator[pa.RecordBatch]:
    """Posts of (key, value, first, count, own) arrays, some at a time."""
    held: list[tuple] = []
    size = 0
    for own in itertools.chain(rows, [None]):
        if own is not None:
            held.append(own)
            size += len(own[0])
        if size > BUFFER or (own is None and size):
            for part, blob in posts(*(np.concatenate([h[i] for h in held]) for i in range(5)), parts, runs):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])
            held, size = [], 0


def posted(docs: DataFrame, size: int, gram: int, parts: int) -> DataFrame:
    """(part, blob): the stretches of each document, dealt by anchor; a task sends rows of one key once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def rows() -> Iterator[tuple]:
            for b in slices(batches, "text"):
                keys = b.column("key").to_numpy()
                fresh = [i for i, k in enumerate(keys.tolist()) if not (k in seen or seen.add(k))]
                b = b.take(pa.array(fresh, pa.int64())) if len(fresh) < b.num_rows else b
                if len(seen) > SEEN_KEYS:
                    seen.clear()
                row, value, first, count, own = anchored(*text_bytes(b.column("text")), size, gram)
                yield b.column("key").to_numpy()[row], value, first, count, own

        return lots(rows(), parts)

    return docs.mapInArrow(find, "part int, blob binary")


def candidates(docs: DataFrame, size: int, gram: int, parts: int) -> DataFrame:
    """(key, blob): the stretches of each document whose anchor occurs again anywhere, or in the stretch itself.

    Anchors are dealt by their value and counted; values carry many of them, packed. A group that counts gets an anchor once
    from each lot of stretches; the stretches themselves are dealt by document.
    """
    return occurring_again(posted(docs, size, gram, parts), parts)


@dataclass
class HotAnchors:
    """Anchors of which one task should not sort all stretches, by buckets of their hashes."""

    bits: int
    buckets: np.ndarray
    weight: int

    def has(self, value: np.ndarray) -> np.ndarray:
        return np.isin((mixed(value) >> np.uint64(64 - self.bits)).astype(np.int64), self.buckets)


def hot_anchors(found: DataFrame, size: int, n_bytes: int) -> HotAnchors:
    """Buckets of anchors whose stretches have more than HOT bytes, and maybe some that have half of it.

    A task tells of buckets that have their share of half of HOT; what it leaves out of all others adds up to less than the
    other half. There are so many buckets that few anchors share one.
    """
    bits = max(12, int(np.ceil(np.log2(32 * max(n_bytes, 1) / HOT))))
    share = HOT / 2 / max(1, found.rdd.getNumPartitions())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits)
        for b in batches:
            if b.num_rows:
                _, value, _, times = unpack(b.column("blob").to_pylist())
                total += np.bincount((mixed(value) >> np.uint64(64 - bits)).astype(np.int64), weights=times + size - 1.0, minlength=1 << bits)
        own = np.flatnonzero(total >= share)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own].astype(np.int64))], ["bucket", "weight"])

    weights = found.mapInArrow(weigh, "bucket long, weight long").groupBy("bucket").agg(F.sum("weight").alias("weight"))
    got = weights.where(F.col("weight") >= HOT / 2).collect()
    return HotAnchors(bits, np.array([r.bucket for r in got], np.int64), sum(r.weight for r in got))


PLACED = "anchor long, bytes binary, places array<struct<key:long,first:int>>"


def in_bitmap(key: str, shared) -> Column:
    """Whether a key may be in a broadcast bitmap; only keys go to Python."""

    @F.pandas_udf("boolean")
    def has(keys: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(keys.to_numpy()))

    return has(key)


def with_candidates(docs: DataFrame, found: DataFrame, sift: bool) -> DataFrame:
    """(key, text, blobs): one row for each different document that has candidates; other texts don't move if ``sift``."""
    if sift:
        docs = docs.where(in_bitmap("key", docs.sparkSession.sparkContext.broadcast(bitmap(found.select("key").distinct()))))
    listed = found.groupBy("key").agg(F.collect_list("blob").alias("blobs"))
    once = docs.groupBy("key").agg(F.first("text").alias("text"))
    return once.join(listed, "key").select("key", "text", "blobs")


def hot_spans(joined: DataFrame, shared, size: int, parts: int) -> DataFrame:
    """(key, begin, end): bytes that repeated strings with hot anchors cover.

    Every string of ``size`` bytes is counted by its hash, as anchors are: equal strings meet in one group, of which there
    are as many as the strings need, and each lot of strings sends equal ones once.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in slices(batches, "text", TOGETHER):
                for key, text, blobs in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("blobs").to_pylist(), strict=True):
                    _, value, first, count = unpack(blobs)
                    pick = np.flatnonzero(shared.value.has(value))
                    if not len(pick):
                        continue
                    raw = np.frombuffer((text or "").encode(), np.uint8)
                    at, one = np.unique(first[pick], return_index=True)  # rows with equal key are listed once each
                    for a, n in zip(at.tolist(), count[pick][one].tolist(), strict=True):
                        for x in range(a, a + n, BUFFER):
                            h = window_hashes(raw[x : min(x + BUFFER, a + n) + size - 1], size)
                            yield np.full(len(h), key), h, np.arange(x, x + len(h)), np.ones(len(h), np.int64), np.zeros(len(h), bool)

        return lots(rows(), parts, runs=True)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = [(np.empty(0, np.int64),) * 3]
            for key, blobs in zip(b.column("key").to_pylist(), b.column("blobs").to_pylist(), strict=True):
                _, _, first, count = unpack(blobs)
                order = np.argsort(first, kind="stable")
                begin, reach = first[order], np.maximum.accumulate((first + count)[order]) + size - 1
                new = np.concatenate([[True], begin[1:] > reach[:-1]])
                last = np.append(np.flatnonzero(new)[1:], len(begin)) - 1
                out.append((np.full(new.sum(), key), begin[new], reach[last]))
            key, begin, end = (np.concatenate([o[i] for o in out]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["key", "begin", "end"])

    again = occurring_again(joined.mapInArrow(find, "part int, blob binary"), parts)
    return again.groupBy("key").agg(F.collect_list("blob").alias("blobs")).mapInArrow(merged, "key long, begin int, end int")


def stretches(joined: DataFrame, shared, size: int) -> DataFrame:
    """(anchor, bytes, places): the bytes of candidate stretches whose anchor is not hot; a task's equal ones share a row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TOGETHER):
            held: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            for key, text, blobs in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("blobs").to_pylist(), strict=True):
                raw = (text or "").encode()
                _, value, first, count = unpack(blobs)
                order = np.lexsort((value, first))
                order = order[~shared.value.has(value)[order]]
                last = -1
                for i in order.tolist():
                    at = int(first[i])
                    if at != last:  # rows with equal key are listed once each
                        last = at
                        held.setdefault((int(value[i].astype(np.int64)), raw[at : at + int(count[i]) + size - 1]), []).append((key, at))
            if held:
                places = list(held.values())
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32)
                flat = np.array([x for p in places for x in p], np.int64)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32))], ["key", "first"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), structs)],
                    ["anchor", "bytes", "places"],
                )

    return joined.mapInArrow(cut, PLACED)


def repeated_starts(texts: list[bytes], times: list[int], size: int) -> list[np.ndarray]:
    """For each byte string the places where a string of ``size`` bytes starts that also starts elsewhere.

    All are sorted as suffixes of one text, in which a sign below every byte parts them; equal starts are then
    neighbours. A byte string with several ``times`` repeats throughout.
    """
    length = np.array([len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum(length + 1)])
    symbols = np.ones(at[-1], np.uint16)
    raw = np.zeros(at[-1], np.uint8)
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    raw[:] = joined
    symbols[:] = joined.astype(np.uint16) + 2
    symbols[at[1:] - 1] = 1
    room = np.maximum(length - size + 1, 0)
    begin = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    order = suffix_order(symbols, begin)
    same = window_hashes(raw, size)[order]
    again = np.zeros(len(raw), bool)
    equal = same[1:] == same[:-1]
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    return [np.arange(room[i]) if times[i] > 1 else np.flatnonzero(again[at[i] : at[i] + room[i]]) for i in range(len(texts))]


def spans_of(pieces: DataFrame, size: int, parts: int) -> DataFrame:
    """(key, begin, end): bytes of documents that repeated strings cover, before overlaps are merged.

    Stretches are dealt by anchor and sorted, by Spark and with its spilling; equal ones arrive in a row and become one
    with a count. Anchors are taken together until there is enough to sort: CHUNK bytes, and HOT for the last one at most, so that
    what the suffix order holds in memory does not grow with the input.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        places: list[list] = []
        anchors: list[int] = []
        weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, begins, ends = [], [], []
            starts = repeated_starts(texts, [sum(len(k) for k, _ in p) for p in places], size)
            for own, where in zip(starts, places, strict=True):
                if len(own):
                    cut = np.flatnonzero(np.diff(own) > size)
                    a, b = own[np.concatenate([[0], cut + 1])], own[np.append(cut, len(own) - 1)] + size
                    for key, first in where:
                        keys.append(np.repeat(key, len(a)))
                        begins.append((first[:, None] + a).reshape(-1))
                        ends.append((first[:, None] + b).reshape(-1))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in ((keys, np.int64), (begins, np.int32), (ends, np.int32))], ["key", "begin", "end"])

        for b in batches:
            flat = b.column("places").flatten()
            key, first = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            at = np.concatenate([[0], np.cumsum([len(x) for x in b.column("places")])])
            for i, (anchor, text) in enumerate(zip(b.column("anchor").to_pylist(), b.column("bytes").to_pylist(), strict=True)):
                where = (key[at[i] : at[i + 1]], first[at[i] : at[i + 1]])
                if anchors and anchor == anchors[-1] and text == texts[-1]:
                    places[-1].append(where)
                    continue
                if weight > CHUNK and anchor != anchors[-1]:
                    yield from flush()
                    texts, places, anchors, weight = [], [], [], 0
                texts.append(text)
                places.append([where])
                anchors.append(anchor)
                weight += len(text)
        if texts:
            yield from flush()

    sorted_ = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor", "bytes")
    return sorted_.mapInArrow(search, "key long, begin int, end int")


def remove_repeats(df: DataFrame, text: str = "text", size: int = SIZE, gram: int = GRAM, anchor_parts: int | None = None, sift: bool = True) -> DataFrame:
    """Add ``n_bytes``, ``spans``, ``kept`` and ``rest``: each text without the UTF-8 bytes that repeated strings cover.

    A byte goes if a string of ``size`` bytes covers it that also starts elsewhere, in the same or another row; overlaps
    count, strings never cross rows, and all are judged on the input. ``spans`` lists the removed runs as (begin, end), none
    touching another; ``kept`` is binary, as a cut may part a character; ``rest`` is its whole characters. A null text is empty and shorter texts than
    ``size`` stay whole; equal rows count as two places. Other columns stay, those that have the names of new ones are
    replaced. Rows are told apart by a 64-bit hash of all their columns; strings by hashes of their bytes.

    Texts move twice, and only where they must: to the places of their anchors that occur again, once for equal rows, and to their
    spans. Between, only stretches around such anchors move, and each task sorts its own. Rows that are repeated go whole, as every
    string of theirs starts elsewhere. Anchors with more than HOT bytes of stretches are not sorted: their strings are
    counted by hash. ``anchor_parts`` groups count anchors, a quarter of the shuffle partitions if not given, and more where
    the texts have more than GROUP_BYTES for each: more of them need less memory each and some more disk. ``sift`` looks keys up in a
    bitmap before texts move, which takes a second Python worker beside a task's own; without it all texts move. An empty table stays empty.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = df.drop("n_bytes", "spans", "kept", "rest")
    key, listed = unused(own, "_key", "_found")
    keyed = own.withColumn(key, F.xxhash64(*[F.to_json(F.struct(F.col(c))) if "map" in t or "variant" in t else F.col(c) for c, t in own.dtypes]))
    docs = keyed.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") >= size)
    copies = docs.groupBy("key").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("bytes"))
    copies = settled(copies.where("copies > 1").select("key", F.lit(0).alias("begin"), F.col("bytes").cast("int").alias("end")))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchor_parts = max(anchor_parts or max(1, parts // 4), -(-n_bytes // GROUP_BYTES))
    found = settled(candidates(docs, size, gram, anchor_parts))
    hot = hot_anchors(found, size, n_bytes)
    shared = spark.sparkContext.broadcast(hot)
    joined = with_candidates(docs, found, sift)
    pieces = spans_of(stretches(joined, shared, size), size, parts)
    if len(hot.buckets):
        pieces = pieces.union(hot_spans(joined, shared, size, max(anchor_parts, -(-2 * hot.weight // GROUP_STARTS))))
    pieces = pieces.union(copies.select("key", "begin", "end"))
    spans = settled(pieces.groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("begin", "end")).alias(listed)))
    if sift:
        touched = in_bitmap(key, spark.sparkContext.broadcast(bitmap(spans.select(key))))
        hit = keyed.where(touched).join(spans, key, "left").drop(key)
        cut_here = hit.unionByName(keyed.where(~touched).drop(key).withColumn(listed, F.lit(None).cast(hit.schema[listed].dataType)))
    else:
        cut_here = keyed.join(spans, key, "left").drop(key)
    schema = own.select("*", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<begin:long,end:long>>").alias("spans"), F.lit(None).cast("binary").alias("kept"), F.lit(None).cast("string").alias("rest")).schema
    names = own.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            raw, at = text_bytes(b.column(text))
            lists, kept = [], []
            found_ = b.column(listed).to_pylist()
            for i, own_ in enumerate(found_):
                part = raw[at[i] : at[i + 1]]
                merged = []
                if own_:
                    edges = np.array(sorted((s["begin"], s["end"]) for s in own_), np.int64)
                    reach = np.maximum.accumulate(edges[:, 1])
                    new = np.concatenate([[True], edges[1:, 0] > reach[:-1]])
                    begin = edges[new, 0]
                    end = np.append(reach[:-1][new[1:]], reach[-1])
                    merged = list(zip(begin.tolist(), end.tolist(), strict=True))
                    gone = np.zeros(len(part) + 1, np.int8)
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, end, -1)
                    part = part[np.cumsum(gone[:-1], dtype=np.int8) == 0]
                lists.append([{"begin": x, "end": y} for x, y in merged])
                kept.append(part.tobytes())
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(np.diff(at)), pa.array(lists, kind), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())],
                [*names, "n_bytes", "spans", "kept", "rest"],
            )

    return cut_here.mapInArrow(cut, schema)
