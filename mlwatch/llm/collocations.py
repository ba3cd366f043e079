"""Phrases of two to four words that stand together more often than their parts do, counted by tries over all positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mlwatch.llm.batches import CODE_LOWER, GRAM, LOWER, mixed, powers, released, slices, text_bytes
from mlwatch.llm.bitmaps import Bitmap, bitmap
from mlwatch.llm.tries import trie
from mlwatch.operators.frames import settled

LONGEST = 4
LEAST = 30
TOP = 2000
WITHIN = 80
SCALE = 2_000_000
SHARD = 300_000
LOT = 1 << 20
SPARE_BITS = 14
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
COUNTED = f"code long, {' long, '.join(WORDS)} long"


def positions(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of every word of a batch (text, lang): start, end, hash of language and word, piece, and row; bytes lower-cased."""
    raw, at = text_bytes(batch.column("text"))
    lang = batch.column("lang").dictionary_encode()
    salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lang.dictionary.to_pylist()], np.uint64)
    inside = ~(BLANK | CUT)[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(CODE_LOWER[raw] * up[: len(raw)], out=total[1:])
    row = np.searchsorted(at, start, "right") - 1
    piece = np.cumsum(CUT[raw])[start] + row if len(start) else start
    word = mixed((total[end] - total[start]) * down[start])
    salt = salts[lang.indices.to_numpy()[row]] if len(row) else np.empty(0, np.uint64)
    return start, end, mixed(word ^ salt), piece, row


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, code, n): how often each word stands in the texts of a language; each lot sends its words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", LOT):
            start, end, code, _, row = positions(b)
            code, at, n = np.unique(code, return_index=True, return_counts=True)
            start, size = start[at], end[at] - start[at]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            raw = LOWER[text_bytes(b.column("text"))[0]]
            spelled = raw[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
            words = pa.Array.from_buffers(pa.string(), len(code), [None, pa.py_buffer(offsets), pa.py_buffer(spelled)])
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(row[at])), words, pa.array(code.view(np.int64)), pa.array(n)], ["lang", "word", "code", "n"])

    return texts.mapInArrow(run, "lang string, word string, code long, n long").groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def run_codes(code: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, at the place where it begins."""
    n = max(0, len(code) - size + 1)
    return reduce(lambda h, j: mixed(h * GRAM + code[j : j + n]), range(1, size), code[:n])


def in_piece(piece: np.ndarray, size: int) -> np.ndarray:
    """Whether a run of ``size`` words lies in one piece, at the place where it begins."""
    n = max(0, len(piece) - size + 1)
    return piece[size - 1 :] == piece[:n]


def leading(code: np.ndarray, bits: int) -> np.ndarray:
    return code >> np.uint64(64 - bits)


def run_counts(texts: DataFrame, shared, sizes: range, part: int, bits: int, cut: int) -> DataFrame:
    """(code, n): how often runs of words stand in the texts whose parts of ``part`` words are all in the shared bitmap.

    Whatever is frequent has frequent parts, so nothing frequent is left out. Each lot sends equal runs once, as the leading
    ``cut`` bits of their hash; the bitmap has the leading ``bits``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Bitmap = shared.value
        for b in slices(batches, "text", LOT):
            _, _, code, piece, _ = positions(b)
            own = known.has(leading(run_codes(code, part), bits))
            for size in sizes:
                fits = in_piece(piece, size)
                for j in range(size - part + 1):
                    fits = fits & own[j : j + len(fits)]
                found, n = np.unique(leading(run_codes(code, size)[fits], cut), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["code", "n"])

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def codes_of(words: np.ndarray) -> np.ndarray:
    """Hash of the sequences of words in the rows, 0 after a sequence's end, as ``run_codes`` gives."""
    out = words[:, 0]
    for j in range(1, words.shape[1]):
        out = np.where(words[:, j] != 0, mixed(out * GRAM + words[:, j]), out)
    return out


def spelled_out(texts: DataFrame, codes: DataFrame, cut: int) -> DataFrame:
    """(w1, ..., w4, n): the longest run at each position that passes the settled ``codes`` of ``cut`` bits, 0 after its end, and how often it stands there.

    All beginnings of two words or more of such a run pass, too; so whatever is frequent begins a run at each of its places.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Bitmap = shared.value
        for b in slices(batches, "text", LOT):
            _, _, code, piece, _ = positions(b)
            whole, length, at = code.copy(), np.ones(len(code), np.int8), np.arange(len(code))
            for size in range(2, LONGEST + 1):
                at = at[: np.searchsorted(at, len(code) - size + 1)]
                at = at[piece[at + size - 1] == piece[at]]
                longer = mixed(whole[at] * GRAM + code[at + size - 1])
                passes = known.has(leading(longer, cut))
                at = at[passes]
                whole[at], length[at] = longer[passes], size
            at = np.flatnonzero(length > 1)
            _, one, n = np.unique(whole[at], return_index=True, return_counts=True)
            at = at[one]
            padded = np.concatenate([code, np.zeros(LONGEST, np.uint64)])
            words = [pa.array(np.where(j < length[at], padded[at + j], np.uint64(0)).view(np.int64)) for j in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([*words, pa.array(n)], [*WORDS, "n"])

    return texts.mapInArrow(run, f"{' long, '.join(WORDS)} long, n long").groupBy(*WORDS).agg(F.sum("n").alias("n"))


def words_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(w).to_numpy().view(np.uint64) for w in WORDS], axis=1)


def dealt(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The same rows, up to ``most`` at a time."""
    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= most:
            yield pa.Table.from_batches([*held, b.slice(0, most - n)])
            held, b, n = [], b.slice(most - n), 0
        held, n = [*held, b], n + b.num_rows
    if n:
        yield pa.Table.from_batches(held)


def trie_counts(runs: DataFrame, shard: int) -> DataFrame:
    """(code, w1, ..., w4, a): how often each beginning of two words or more of the settled runs (w1, ..., w4, n) stands in the texts.

    Runs are dealt by their first two words, so that each position is walked once, however many candidates there are. Some
    runs at a time make a trie of their beginnings, ``shard`` at most, and all of them go through it at once, as often as they stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in dealt(batches, max(1, shard // (LONGEST - 1))):
            words, n = words_of(lot), lot.column("n").to_numpy()
            length = (words != 0).sum(axis=1)
            begins = np.concatenate([np.where(np.arange(LONGEST) < size, words[length >= size], np.uint64(0)) for size in range(2, LONGEST + 1)])
            t = trie(begins[np.unique(codes_of(begins), return_index=True)[1]])
            begin, total = np.cumsum(length) - length, np.zeros(len(t.sequences), np.int64)
            row = np.repeat(np.arange(len(words)), length)
            for at, ends in t.walked(t.ids(words[words != 0]), row, begin):
                total += np.bincount(ends, n[row[at]], len(total)).astype(np.int64)
            found = np.where(t.sequences >= 0, t.labels[t.sequences], np.uint64(0))
            columns = [codes_of(found), *found.T]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns], pa.array(total)], ["code", *WORDS, "a"])
        released()

    tries = -(-runs.count() * (LONGEST - 1) // shard)
    counted = runs.repartition(max(1, tries), *WORDS[:2]).mapInArrow(run, f"{COUNTED}, a long")
    return counted.groupBy("code", *WORDS).agg(F.sum("a").alias("a"))


def parts_of(phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, k, left, right): the hashes of both parts of each sequence cut after ``k`` words; and (code, inner): of the
    shorter sequences of two words or more inside each."""

    def parts(batches: Iterator[pa.RecordBatch], cuts: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = words_of(b)
            length, code = (words != 0).sum(axis=1), b.column("code").to_numpy()
            for size in range(2, LONGEST + 1):
                own, at = words[length == size][:, :size], code[length == size]
                if cuts:
                    for k in range(1, size):
                        sides = [pa.array(codes_of(x).view(np.int64)) for x in (own[:, :k], own[:, k:])]
                        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), k, np.int32)), *sides], ["code", "k", "left", "right"])
                else:
                    for n in range(2, size):
                        for i in range(size - n + 1):
                            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(codes_of(own[:, i : i + n]).view(np.int64))], ["code", "inner"])

    cut = phrases.mapInArrow(lambda batches: parts(batches, True), "code long, k int, left long, right long")
    return cut, phrases.mapInArrow(lambda batches: parts(batches, False), "code long, inner long")


def exact(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def scored(phrases: DataFrame, words: DataFrame, cuts: DataFrame) -> DataFrame:
    """(code, a, l, r, score) for (code, a): the cut with the lowest score, of equal ones the earliest."""
    known = phrases.select("code", "a").union(words.select("code", "n"))
    cut = cuts.join(phrases, "code")
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(known.select(F.col("code").alias(side), F.col("a").alias(name)), side)
    cut = cut.withColumn("over", exact("l") + exact("r")).withColumn("times", exact("a") * F.lit(SCALE).cast("decimal(10,0)"))
    cut = cut.withColumn("score", F.expr("times div over"))
    return cut.groupBy("code", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("code", "a", "low.l", "low.r", "low.score")


def absorbed(phrases: DataFrame, inner: DataFrame, within: int) -> DataFrame:
    """(code): phrases that lie inside a longer one which is nearly as frequent."""
    longer = inner.join(phrases, "code").groupBy(F.col("inner").alias("code")).agg(F.max("a").alias("longer"))
    return phrases.join(longer, "code").where(exact("longer") * 100 >= exact("a") * within).select("code")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, within: int = WITHIN, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language, best first.

    A-Z are lower-cased; texts fall into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs, and a phrase lies
    in one piece. ``a`` is how often it stands there, overlaps included, at least ``least`` times; ``n`` is the number of
    words of its language. Each way to cut it in two, with frequencies ``l`` and ``r``, gives floor(2,000,000 a / (l + r)),
    of which the lowest counts. Phrases inside a longer frequent one that has ``within`` percent of their frequency go.
    Equal scores are ordered by frequency, then by the phrase. A null language is ``und``; null, empty and blank texts have
    no words; repeated rows count as often as they stand; an empty table gives no rows; other columns are not read.
    Words and phrases are told apart by 64-bit hashes, counts are exact.

    Words are counted first, then pairs of frequent words, then runs of three and four whose pairs are frequent, by hashes
    that may take other runs along. The longest run of these at each position is spelled out, and equal ones are sent once;
    tries of their beginnings, ``shard`` to a trie, count them. What tasks hold does not grow with the input, and the texts are
    read four times, however many candidates there are. The filters between the steps are bitmaps of at most 8 MB.
    """
    if least < 1 or shard < 1:
        raise ValueError("least and shard must be at least 1")
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null")
    spark = df.sparkSession
    counts = settled(word_counts(texts))
    words = counts.where(F.col("n") >= least)
    shared = spark.sparkContext.broadcast(bitmap(words.select("code")))
    # so many bits that runs that meet by chance add little to a count
    cut = min(64, int(counts.agg(F.sum("n")).first()[0] or 0).bit_length() + SPARE_BITS)
    pairs = settled(run_counts(texts, shared, range(2, 3), 1, 64, cut).where(F.col("n") >= least).select("code"))
    shared = spark.sparkContext.broadcast(bitmap(pairs))
    longer = run_counts(texts, shared, range(3, LONGEST + 1), 2, cut, cut).where(F.col("n") >= least).select("code")
    runs = settled(spelled_out(texts, settled(pairs.union(longer).distinct()), cut))
    spelled = settled(trie_counts(runs, shard).where(F.col("a") >= least))
    phrases, (cuts, inner) = spelled.select("code", "a"), parts_of(spelled.drop("a"))
    best = settled(scored(phrases, words, cuts).join(absorbed(phrases, inner, within), "code", "left_anti"))
    listed = spelled.join(best.select("code"), "code", "left_semi")
    spelled = listed.select(F.col("code").alias("whole"), F.posexplode(F.filter(F.array(*WORDS), lambda w: w != 0)).alias("i", "code"))
    spelled = spelled.join(words.select("code", "word", "lang"), "code").groupBy(F.col("whole").alias("code"))
    spelled = spelled.agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("spelled"))
    shown = best.join(spelled, "code").select("lang", F.concat_ws(" ", F.col("spelled.word")).alias("phrase"), "a", "l", "r", "score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = shown.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
