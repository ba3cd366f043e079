"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, less exception phrases, over the text's length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.llm.batches import slices
from mlwatch.llm.labelled import labelled

MOST_ROWS = 20_000
SHORTEST, LONGEST = 4, 8
MOST_TERMS = 5_000
# Look-alikes of Latin letters in other scripts, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "υ": "u", "κ": "k",
    "ν": "v", "τ": "t", "χ": "x", "ı": "i", "ł": "i", "ø": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
INSIDE = re.compile(r"(?<=\w)[!|](?=\w)")
START, END = "\x02", "\x03"


def _fold_table() -> dict[int, str]:
    table = {ord(a): b for a, b in (LOOKALIKES | DIGITS).items()}
    for code in range(0xFF01, 0xFF5F):  # full-width forms
        plain = chr(code - 0xFEE0).lower()
        table[code] = table.get(ord(plain), plain)
    for code in [*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD, *range(0x335, 0x339)]:
        table[code] = ""  # invisible signs and strokes
    for code in (*range(9, 14), 32, *b".,;:?!|\"'()[]{}<>-_/\\+*=#%&^~`"):
        table[code] = END + START
    return table


FOLD = _fold_table()


def fold(text: str) -> str:
    """Words of a text in plain small letters, each between START and END.

    Letters and accents are composed, look-alikes from other scripts become Latin letters, and digits and signs the letters they stand for.
    An exclamation mark or bar between letters is an i, and so is an l, which looks like one.
    """
    if "!" in text or "|" in text:
        text = INSIDE.sub("i", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return START + text.lower().translate(FOLD) + END


@dataclass
class Lexicon:
    """Terms with weights, phrases that excuse the terms inside them, and the curve from densities to a probability."""

    terms: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, ...]

    def automaton(self) -> ahocorasick.Automaton:
        found = getattr(self, "_automaton", None)
        if found is None:
            found = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                found.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                found.add_word(phrase, (len(phrase), 0.0))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return found

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve}

    def weigh(self, folded: str) -> tuple[float, int]:
        """Total weight of the terms outside exception phrases, the heaviest of those that share a start, and how many."""
        a = self.automaton()
        if not len(a):
            return 0.0, 0
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in a.iter(folded):
            begin = end - size + 1
            if weight == 0.0:
                excused.append((begin, end))
            elif weight > best.get(begin, -1.0):
                best[begin] = weight
        if excused and best:
            for b, e in excused:
                for begin in [x for x in best if b <= x <= e]:
                    del best[begin]
        return sum(best.values()), len(best)

    def shape(self, text: str) -> list[float]:
        folded = fold(text)
        total, hits = self.weigh(folded)
        n = max(1, folded.count(START) - folded.count(START + END))
        return [1.0, math.log1p(100.0 * total / n), math.log1p(total), float(hits > 0), math.log(n) * (hits > 0)]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.curve, self.shape(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def starts(text: str) -> list[str]:
    """Folded words of a text, each after START and, whole ones, before END."""
    return [w for w in fold(text).split(END) if len(w) > 1]


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, docs, toxic, clean): toxic documents that have a word start or whole word, and how often either label has it.

    The term ``""`` has the numbers of all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, toxic, clean = Counter(), Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                own = Counter()
                for w, n in Counter(starts(text)).items():
                    own[""] += n
                    for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1):
                        own[w[: k + 1]] += n
                    if len(w) > SHORTEST - 1:
                        own[w + END] += n
                if label:
                    docs.update(own.keys())
                (toxic if label else clean).update(own)
                if len(toxic) + len(clean) > 500_000:
                    yield table(docs, toxic, clean)
                    docs, toxic, clean = Counter(), Counter(), Counter()
        yield table(docs, toxic, clean)

    def table(*counts: Counter) -> pa.RecordBatch:
        names = list(counts[1].keys() | counts[2].keys())
        columns = [pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in counts]]
        return pa.RecordBatch.from_arrays(columns, ["term", "docs", "toxic", "clean"])

    counted = rows.mapInArrow(run, "term string, docs long, toxic long, clean long")
    return counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "clean")])


def choose_terms(counts: DataFrame, support: int, least: float, evidence: float) -> dict[str, float]:
    """Terms that mark toxic texts: log odds of their rates among words, for those that ``support`` toxic documents have.

    Evidence, documents times weight, grows with the sample, so that what chance finds among very many starts stays
    out. A longer start goes where a shorter one says as much, and a whole word where its start does.
    """
    whole = counts.where(F.col("term") == "").first()
    if whole is None or not whole.toxic or not whole.clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(float(whole.toxic))) - F.log((F.col("clean") + 0.5) / F.lit(float(whole.clean)))
    rows = (
        counts.where((F.col("docs") >= support) & (F.col("term") != ""))
        .withColumn("weight", odds)
        .where((F.col("weight") >= least) & (F.col("docs") * F.col("weight") >= evidence))
        .orderBy(F.desc(F.col("docs") * F.col("weight")), "term")
        .limit(MOST_TERMS)
        .collect()
    )
    terms = {r.term: float(r.weight) for r in rows}

    def said(t: str, weight: float) -> bool:
        return any(terms.get(t[:k], -1.0) >= weight - 0.7 for k in range(SHORTEST + 1, len(t)))

    return {t: w for t, w in terms.items() if not said(t, w)}


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", text: str = "text", most: int = MOST_ROWS,
          support: int = 8, least: float = 2.0, evidence: float = 50.0, phrase_support: int = 3) -> Lexicon:
    """Learn a lexicon from a bounded sample of labelled rows: at most ``most`` labelled ids for which ``learn`` holds.

    Terms are counted in Spark by label; at most ``MOST_TERMS`` are kept. Then every row of the sample is matched once
    more, for phrases of two words that hold a term, occur in ``phrase_support`` clean documents and in no toxic
    one: exceptions. A last pass gives five numbers a row, from which the curve is fitted by Newton's method. Without rows
    of both labels the lexicon is empty and the score is the share of label 1, or 0.5 without any.
    """
    rows = labelled(docs, labels, label, learn, most, text)
    by_label = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = by_label.get(1, 0), by_label.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, frozenset(), ({(0, 0): 0.0}.get((n_toxic, n_clean), 4.0 if n_toxic else -4.0), 0.0, 0.0, 0.0, 0.0))
    terms = choose_terms(term_counts(rows), support, least, evidence)
    bare = Lexicon(terms, frozenset(), (0.0,) * 5)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text_, label_ in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                own = starts(text_)
                found = set()
                for i, w in enumerate(own):
                    if bare.weigh(w + END)[1]:
                        found.update(END.join(own[j : j + 2]) + END for j in (i - 1, i) if j >= 0 and j + 2 <= len(own))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(found)), pa.array([int(label_)] * len(found), pa.int64())], ["phrase", "label"]
                    )

    exceptions = (
        rows.mapInArrow(phrases, "phrase string, label long")
        .groupBy("phrase")
        .agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
        .where((F.col("toxic") == 0) & (F.col("n") >= phrase_support))
        .orderBy(F.desc("n"), "phrase")
        .limit(MOST_TERMS)
        .collect()
    )
    lexicon = Lexicon(terms, frozenset(r.phrase for r in exceptions), (0.0,) * 5)

    def shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([[float(y), *lexicon.shape(t)] for t, y in zip(p.text, p.label, strict=True)], columns=list("yabcde"))

    points = rows.mapInPandas(shapes, "y double, a double, b double, c double, d double, e double")
    got = points.groupBy(*points.columns).count().toPandas().sort_values(points.columns)
    return Lexicon(terms, lexicon.exceptions, newton(got[list("abcde")].to_numpy(), got.y.to_numpy(), got["count"].to_numpy()))


def newton(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> tuple[float, ...]:
    """Logistic regression with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (n * (p - y)) + ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "score") -> DataFrame:
    """Add the probability that a whole text is toxic.

    A null text counts as empty; an empty text has no terms, and the score of the curve's first number. Columns and
    repeated rows stay; a column that has the name of the new one is replaced. One narrow pass; the lexicon is bounded.
    """
    kept = df.drop(into)
    schema = kept.select("*", F.lit(0.0).alias(into)).schema
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, text):
            out = pa.array([own.score(t or "") for t in b.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, into])

    return kept.mapInArrow(run, schema)
