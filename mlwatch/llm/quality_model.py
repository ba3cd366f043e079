"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.llm.batches import mixed, slices, text_bytes, words
from mlwatch.llm.labelled import labelled

BITS = 18
SHARDS = 8
MOST_ROWS = 20_000
KINDS = 6
SCALE = 10.0
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
SMALL = np.zeros(256, np.int64)
SMALL[97:123] = 1


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each word of each row, (KINDS, words); the row of each word; the words per row.

    The kinds: the word; the word and the next; the word's shape; two and three shapes in a row; and whether the word,
    or the run of five words from it, stood before in the same row. A shape is the first and last sign where they are
    no letters, whether small and capital letters occur, and whether a line ends before the word.
    """
    start, end, h, rows = words(raw, at)
    count = np.diff(rows)
    row = np.repeat(np.arange(len(count)), count)
    n = len(h)
    if not n:
        return np.empty((KINDS, 0), np.int64), row, count
    has_upper = np.add.reduceat(UPPER[raw], start) > 0
    has_small = np.add.reduceat(SMALL[raw], start) > 0
    line = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=line[1:])
    broke = np.zeros(n, bool)
    broke[1:] = line[start[1:]] > line[start[:-1]]
    first, last = raw[start].astype(np.uint64), raw[end - 1].astype(np.uint64)
    shape = np.where(LETTER[first.astype(int)], np.uint64(0), first) | np.where(LETTER[last.astype(int)], np.uint64(0), last) << np.uint64(8)
    shape |= has_upper.astype(np.uint64) << np.uint64(16) | has_small.astype(np.uint64) << np.uint64(17)
    shape |= broke.astype(np.uint64) << np.uint64(18) | (end - start == 1).astype(np.uint64) << np.uint64(19)
    shape = mixed(shape + np.uint64(1))

    def follow(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        if k < n:
            out[:-k] = np.where(row[:-k] == row[k:], x[k:], np.uint64(0))
        return out

    def seen(x: np.ndarray) -> np.ndarray:
        own = mixed(x + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own, kind="stable")
        again = np.zeros(n, bool)
        again[order[1:]] = own[order[1:]] == own[order[:-1]]
        return again.astype(np.uint64)

    three, seven = np.uint64(3), np.uint64(7)
    next_shape = follow(shape, 1)
    run = h + follow(h, 1) * three + follow(h, 2) * seven + follow(h, 3) * np.uint64(11) + follow(h, 4) * np.uint64(13)
    stood = seen(run) | seen(h + follow(h, 1) * three) << np.uint64(1)
    kinds = [h, h * three + follow(h, 1), shape, shape * three + next_shape, shape * seven + next_shape * three + follow(shape, 2), stood]
    buckets = np.empty((KINDS, n), np.int64)
    for k, x in enumerate(kinds):
        buckets[k] = mixed(x + np.uint64(k * 0x1E8FEB86659FD93)) >> np.uint64(64 - BITS)
    return buckets, row, count


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the intercept."""

    weights: np.ndarray
    intercept: float

    def margins(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sparse dot product of each row's mean feature counts with the weights."""
        buckets, row, count = features(raw, at)
        total = np.bincount(row, weights=self.weights[buckets].sum(axis=0), minlength=len(count))
        return self.intercept + SCALE * total / np.maximum(count, 1)

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(raw, at), -500, 500)))


def leader(texts: list[str], labels: np.ndarray, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> Model:
    """Follow-the-regularised-leader over the rows one by one, with a rate of its own for each coordinate."""
    size = 1 << BITS
    z, squares = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        buckets, _, count = features(raw, np.array([0, len(raw)]))
        own, times = np.unique(buckets, return_counts=True)
        rows.append((np.append(own, size), np.append(SCALE * times / max(int(count[0]), 1), 1.0)))
    free = size  # the intercept is not regularised
    for _ in range(epochs):
        for (own, x), y in zip(rows, labels, strict=True):
            zi, ni = z[own], squares[own]
            bound = np.where(own == free, 0.0, l1)
            w = np.where(np.abs(zi) <= bound, 0.0, (np.sign(zi) * bound - zi) / ((beta + np.sqrt(ni)) / alpha + np.where(own == free, 0.0, l2)))
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[own] = zi + g - sigma * w
            squares[own] = ni + g * g
    bound = np.full(size + 1, l1)
    bound[free] = 0.0
    w = np.where(np.abs(z) <= bound, 0.0, (np.sign(z) * bound - z) / ((beta + np.sqrt(squares)) / alpha + l2))
    return Model(w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", text: str = "text", most: int = MOST_ROWS,
          alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.0, epochs: int = 3) -> Model:
    """Fit on a bounded sample of labelled rows: at most ``most`` labelled ids for which ``learn`` holds.

    The sample is dealt into ``SHARDS`` parts by a hash of the id; each is trained in a task of its own, and the mean of
    their weights, a table of fixed size, is the model. Without any labelled row the model scores 0.5 throughout.
    """
    rows = labelled(docs, labels, label, learn, most, text).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text"])
        order = np.random.default_rng(1).permutation(len(part))
        m = leader(part.text.to_numpy()[order].tolist(), part.label.to_numpy()[order], alpha, beta, l1, l2, epochs)
        return pd.DataFrame({"weights": [m.weights.astype(np.float32).tobytes()], "intercept": [m.intercept]})

    fitted = rows.groupBy("shard").applyInPandas(fit, "weights binary, intercept double").collect()
    if not fitted:
        return Model(np.zeros(1 << BITS), 0.0)
    weights = np.mean([np.frombuffer(r.weights, np.float32) for r in fitted], axis=0, dtype=np.float64)
    return Model(weights, float(np.mean([r.intercept for r in fitted])))


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the probability of label 1 for each whole text.

    A null text counts as empty; an empty text has the score of the intercept alone. Columns and repeated rows stay;
    a column that has the name of the new one is replaced. One narrow pass; the model has a fixed size.
    """
    kept = df.drop(into)
    schema = kept.select("*", F.lit(0.0).alias(into)).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            out = pa.array(shared.value.scores(*text_bytes(b.column(text))))
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, into])

    return kept.mapInArrow(run, schema)
