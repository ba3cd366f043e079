"""Language-model scores of whole documents: counts and training on Spark, a recurrent network for each task's texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.llm.batches import slices, text_bytes, words
from mlwatch.llm.recurrent import Layout, Network, fit, log_likelihood
from mlwatch.operators.frames import settled

WORDS = 2_048
LISTED = 1 << 17
GROUPS = 12
PART_TOKENS = 4_000_000
TOGETHER = 8 << 20
MERGE = 1_500_000
SIGN = np.array([0 if chr(b).isalnum() or b >= 128 else 3 for b in range(256)], np.int8)
END = np.uint64(0)


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and group of every word, A-Z lower-cased, and the offsets of the rows. A group tells a word's form: its length in
    three steps, whether it ends in a sign, and whether it has other letters than A to Z."""
    start, end, h, rows = words(raw, at)
    if not len(h):
        return h, np.empty(0, np.int8), rows
    size = end - start
    form = SIGN.take(raw[end - 1])
    form += size > 4
    form += size > 8
    form += np.int8(6) * (np.maximum.reduceat(raw, start) >= 128)  # what lies before the next word has no such letters
    h[h == END] = 1
    return h, form, rows


def tallied(h: np.ndarray, g: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, a group of each, and the sums of their counts ``n``, or their numbers."""
    order = np.argsort(h)
    own = h[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(h) else np.empty(0, np.int64)
    sums = np.diff(first, append=len(h)) if n is None or not len(h) else np.add.reduceat(n[order], first)
    return own[first], g[order[first]], sums.astype(np.int64)


@dataclass
class Model:
    """Counts of the most frequent words by hash, totals, and the network."""

    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    n: int
    distinct: int
    group_n: np.ndarray
    group_distinct: np.ndarray
    network: np.ndarray
    layout: Layout
    hidden: int

    def net(self) -> Network:
        found = getattr(self, "_net", None)
        if found is None:
            found = self._net = Network(self.layout, self.hidden).load(self.network)
        return found

    def slots(self) -> np.ndarray:
        """For every value of a hash's first bits, where the listed hashes from it on begin; some eight values to a listed hash."""
        found = getattr(self, "_slots", None)
        if found is None:
            bits = min(20, len(self.hashes).bit_length() + 3)
            begin = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            found = self._slots = np.minimum(np.searchsorted(self.hashes, begin), len(self.hashes) - 1)
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_net", "_slots")}

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether hashes are listed, and where: the first bits lead to a listed hash, from which few steps are left."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        slots, last = self.slots(), len(self.hashes) - 1
        at = slots[h >> np.uint64(65 - len(slots).bit_length())]
        here = self.hashes[at]
        listed = here == h
        left = np.flatnonzero(here < h)
        while len(left := left[at[left] < last]):
            at[left] += 1
            here, wanted = self.hashes[at[left]], h[left]
            listed[left] = here == wanted
            left = left[here < wanted]
        return listed, at

    def symbols(self, h: np.ndarray, group: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Symbols of words, from what ``lookup`` has ``found`` for them."""
        listed, at = found or self.lookup(h)
        place = self.places[at] if len(self.hashes) else np.full(len(h), -1)
        return np.where(listed & (place >= 0), place, np.int32(self.layout.words) + group).astype(np.int32)

    def end(self) -> int:
        return int(self.symbols(np.array([END]), np.zeros(1, np.int8))[0])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, form, n) over all of ``docs``: hash, group and count of each word, and of the end, which has hash 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return tallied(*(np.concatenate([x[i] for x in held]) for i in range(3)))

        def out() -> pa.RecordBatch:
            h, g, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(g, pa.int8()), pa.array(n)], ["word", "form", "n"])

        for b in slices(batches, "text"):
            h, g, rows = tokens(*text_bytes(b.column("text")))
            held.append(tallied(h, g))
            held.append((np.array([END]), np.zeros(1, np.int8), np.array([len(rows) - 1])))
            size += len(held[-2][0])
            if size > MERGE:
                held = [merged()]
                size = len(held[0][0])
                if size > MERGE // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counted = docs.mapInArrow(run, "word long, form byte, n long")
    return counted.groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n"))


def average(vectors: DataFrame) -> np.ndarray | None:
    """Mean of (piece, part, weight, vector) rows by piece, weighted, joined to one vector; no row is larger than a piece."""

    def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = sum(w * np.frombuffer(v, np.float32).astype(np.float64) for w, v in zip(rows["weight"], rows["vector"], strict=True))
        return pd.DataFrame({"piece": [key[0]], "vector": [(total / rows["weight"].sum()).astype(np.float32).tobytes()]})

    got = vectors.groupBy("piece").applyInPandas(mean, "piece int, vector binary").collect()
    return np.concatenate([np.frombuffer(r.vector, np.float32) for r in sorted(got, key=lambda r: r.piece)]) if got else None


def dealt(docs: DataFrame, shared, key: str, parts: int) -> DataFrame:
    """(part, key, ids): every text as the network's symbols, and the part that learns from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, "text"):
            h, g, rows = tokens(*text_bytes(b.column("text")))
            ids = own.symbols(h, g).astype("<i4").tobytes()
            blobs = pa.array([ids[4 * x : 4 * y] for x, y in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column(key), blobs], ["part", key, "ids"])

    part = F.pmod(F.xxhash64(key, F.lit(13)), F.lit(parts)).cast("int").alias("part")
    return docs.select(part, key, "text").mapInArrow(run, f"part int, {key} long, ids binary")


def learner(shared, step: float, key: str, pieces: int):
    """One part's training: from the shared model's network once through its texts, and its weights in pieces."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        own, part = shared.value, int(rows["part"].iloc[0])
        texts = rows.sort_values([key, "ids"])["ids"].tolist()
        symbols = np.frombuffer(b"".join(texts), "<i4")
        offsets = np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts])])
        net = fit(Network(own.layout, own.hidden).load(own.network), symbols, offsets, own.end(), step, 0.3)
        flat, cuts = net.vector(), np.linspace(0, len(own.network), pieces + 1).astype(int)
        vectors = [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        weight = float(len(symbols) + len(offsets))
        return pd.DataFrame({"piece": np.arange(pieces, dtype=np.int32), "part": np.int32(part), "weight": weight, "vector": vectors})

    return learn


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words from some count on, that are ``most`` at most. Counts are told apart in sixteen steps for each doubling, so that
    finding the limit takes one row per step, not a sort."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    total, limit = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        total += r.words
        if total > most:
            break
        limit = r.step
    return counts.where(F.lit(False) if limit is None else step >= limit)


def train(docs: DataFrame, counts: DataFrame, key: str = "deal", rounds: int = 1, rate: float = 0.02, hidden: int = 32) -> Model:
    """Totals and the most frequent words of settled ``counts``, and a network trained on the texts of ``docs``.

    Counts and backpropagation cover all documents. Texts are dealt by a hash of the whole row, so that copies are spread, to
    parts of some PART_TOKENS tokens, whatever the session's settings; each part is gone through once from the same start,
    the mean of the networks, weighted by tokens, is the next start, and there are ``rounds`` of this.
    """
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, LISTED).select("word", "form", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    if not (top["word"] == 0).any():
        end = counts.where("word = 0").first()
        top = pd.concat([top, pd.DataFrame({"word": [0], "form": [0], "n": [end.n if end else 0]})], ignore_index=True)
    first = np.zeros(len(top), bool)
    first[:WORDS] = True
    first[np.flatnonzero(top["word"].to_numpy() == 0)] = True
    places = np.full(len(top), -1, np.int64)
    places[first] = np.arange(first.sum())
    hashes = top["word"].to_numpy(np.int64).astype(np.uint64)
    n = top["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    group_n, group_distinct = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for r in counts.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():
        group_n[r.form], group_distinct[r.form] = r.n, r.d
    forms = top["form"].to_numpy(np.int64)[first & (n > 0)]
    group_n -= np.bincount(forms, weights=n[first & (n > 0)], minlength=GROUPS).astype(np.int64)
    group_distinct -= np.bincount(forms, minlength=GROUPS)
    layout = Layout.by_frequency(n[first], GROUPS)
    net = Network(layout, hidden).start(n[first], group_n)
    model = Model(hashes[order], n[order], places[order], int(totals[0]), int(totals[1]), group_n, group_distinct, net.vector(), layout, hidden)

    parts = max(1, -(-model.n // PART_TOKENS))
    pieces = max(16, parts // 16)
    for i in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        learn = learner(shared, rate / (1 + 2 * i), key, pieces)
        mean = average(dealt(docs, shared, key, parts).groupBy("part").applyInPandas(learn, "piece int, part int, weight double, vector binary"))
        if mean is None:
            break
        model.network = mean
        model.__dict__.pop("_net", None)
    return model


def listed_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(key, n_tokens, n_known, base, score): what tokens that the model lists, and the network, give each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        below = np.log10(float(own.n + own.distinct + 1))
        base = np.log10(own.counts + 1.0) - below
        inside, group = np.log10(own.counts + 1.0), np.log10(own.group_n + own.group_distinct + 1.0)
        held: list[tuple] = []
        weight = 0

        def out() -> pa.RecordBatch:
            symbols = np.concatenate([h[0] for h in held])
            size = np.concatenate([h[1] for h in held])
            offsets = np.concatenate([[0], np.cumsum(size)])
            got = log_likelihood(own.net(), symbols, offsets, own.end()) / np.log(10.0)
            key, known, based, extra = (np.concatenate([h[i] for h in held]) for i in range(2, 6))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(size + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(based), pa.array(got + extra)], ["key", "n_tokens", "n_known", "base", "score"])

        end_listed, end_at = own.lookup(np.array([END]))
        end_count = own.counts[end_at[0]]
        for b in slices(batches, "text"):
            raw, at = text_bytes(b.column("text"))
            h, g, rows = tokens(raw, at)
            listed, place = own.lookup(h)
            row = np.repeat(np.arange(b.num_rows), np.diff(rows))
            known = np.diff(np.append(0, np.cumsum(listed))[rows])
            based = np.bincount(row, weights=np.where(listed, base[place], 0.0), minlength=b.num_rows)
            outside = np.flatnonzero(listed & (own.places[place] < 0))
            extra = np.bincount(row[outside], weights=inside[place[outside]] - group[g[outside]], minlength=b.num_rows)
            held.append((own.symbols(h, g, (listed, place)), np.diff(rows), b.column("key").to_numpy(), known + int(end_count > 0), based + base[end_at[0]], extra))
            weight += len(raw)
            if weight > TOGETHER:
                yield out()
                held, weight = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "key long, n_tokens long, n_known long, base double, score double")


def unlisted(docs: DataFrame, model: Model) -> DataFrame:
    """(key, word, form, times): the words of each row that the model does not list."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, "text"):
            h, g, rows = tokens(*text_bytes(b.column("text")))
            rare = ~own.lookup(h)[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(rows))[rare]
            h, g = h[rare], g[rare]
            order = np.lexsort((h, row))
            h, g, row = h[order], g[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column("key").to_numpy()[row[first]]), pa.array(h[first].astype(np.int64)), pa.array(g[first], pa.int8()), pa.array(times, pa.int64())],
                ["key", "word", "form", "times"],
            )

    return docs.mapInArrow(run, "key long, word long, form byte, times long")


def score(df: DataFrame, learn: Column, text: str = "text", rounds: int = 1) -> DataFrame:
    """Add ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` to every row, learning from those for
    which ``learn`` holds.

    Tokens are words, A-Z lower-cased, and an end. ``base_score`` adds log10((c + 1) / (N + V + 1)) over tokens. ``score`` is
    the model's log10 probability of the whole text: the network gives a class, then a word of the class, or, for words it
    has no place for, the group of their form, within which they have the probability of their count. Counts of the
    most frequent words, a bounded number, go to every task; for the others rows of (document, word) meet the
    counts in a join. A null text is empty: its only token is the end. With nothing to learn from N and V are 0 and the
    network is as it starts. Repeated rows have equal scores; other columns stay, those that have the names of new ones are
    replaced. Rows and words are told apart by 64-bit hashes.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = df.drop(*new, "_key")
    keyed = kept.withColumn("_learn", F.coalesce(learn, F.lit(False))).withColumn("_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    known = [F.col(c) for c, t in df.dtypes if "map" not in t and "variant" not in t]
    slim = keyed.select(F.col("_key").alias("key"), F.xxhash64(*known).alias("deal"), F.coalesce(F.col(text), F.lit("")).alias("text"), "_learn")
    training = slim.where("_learn").select("deal", "text")
    counts = settled(word_counts(training))
    model = train(training, counts, rounds=rounds)
    docs = slim.select("key", "text")
    # copies of a text give equal rows: one of its own scores is kept, and its sums over words are divided by its copies
    scored = listed_scores(docs, model).groupBy("key").agg(*[F.first(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")], F.count("*").alias("copies"))
    rest = unlisted(docs, model).join(counts.select("word", "n"), "word", "left")
    count = F.coalesce("n", F.lit(0))
    below = F.element_at(F.array(*[F.lit(float(np.log10(a + b + 1.0))) for a, b in zip(model.group_n, model.group_distinct, strict=True)]), F.col("form").cast("int") + 1)
    rest = rest.groupBy("key").agg(
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * (F.log10(count + 1.0) - F.lit(float(np.log10(model.n + model.distinct + 1.0))))).alias("base2"),
        F.sum(F.col("times") * (F.log10(count + 1.0) - below)).alias("score2"),
    )
    both = scored.join(rest, "key", "left").select(
        F.col("key").alias("_key"), "n_tokens",
        (F.col("n_known") + F.coalesce(F.expr("known div copies"), F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("base2") / F.col("copies"), F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("score2") / F.col("copies"), F.lit(0.0))).alias("score"),
    )
    return keyed.drop("_learn").join(both, "_key").select(*kept.columns, *new)
