"""Collocations and tries against plain counting."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from mlwatch.llm.bitmaps import bitmap
from mlwatch.llm.collocations import collocations, trie_counts
from mlwatch.llm.tries import trie

FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def plain(rows, least, top, within):
    """Count every run of one to four words, then cut, drop and rank."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, w), a in found.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        longer = [b for (o, v), b in found.items() if o == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= within * a for b in longer):
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    ranks, result = collections.Counter(), []
    for lang, score, a, phrase, lhs, rhs in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], phrase.decode(), -a, lhs, rhs, n[lang], -score))
    return sorted(result)


def make_rows():
    rng = random.Random(3)
    vocabulary = ["of", "THE", "the", "new", "york", "é", "漢字", "A", "x\x00y", "l'eau", "#tag", "e-mail"]
    gaps = [" "] * 8 + [", ", ".", "\n", "  ", "\t", "?! ", " "]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(n))
    rows = [(None, "en"), ("", "en"), (" \t\n", None), ("one", "xx"), ("one two", ""), ("to be or not " * 40, "en"), ("ha " * 200, "de"), ("ha " * 200, None)]
    rows += [(say(rng.randint(1, 60)), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [("the of new york of", "en")] * 30 + [(say(20_000), "fr")]
    return rows


@pytest.mark.parametrize(("least", "top", "within", "shard"), [(3, 50, 80, 500_000), (30, 2000, 80, 40), (1, 10_000, 100, 700)])
def test_against_plain(spark, least, top, within, shard):
    rows = make_rows()[: -1 if least == 1 else None]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, code int, w1 string").repartition(3)
    got = collocations(df, least=least, top=top, within=within, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top, within)


def test_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations(empty).collect() == []
    assert collocations(spark.createDataFrame([(None, None), ("", "en"), ("one", "en")], "text string, lang string"), least=1).collect() == []
    with pytest.raises(ValueError, match="at least 1"):
        collocations(empty, least=0)


@pytest.mark.parametrize("shard", [40, 500_000])
def test_texts_are_read_four_times(spark, shard):
    rows, read = make_rows()[:-1], spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).mapInArrow(seen, "text string, lang string")
    got = collocations(df.where("text is not null"), least=2, shard=shard).collect()
    assert sorted(map(tuple, got)) == plain(rows, 2, 2000, 80)
    assert read.value == 4 * len(rows)


@pytest.mark.parametrize("shard", [1, 5, 1000])
def test_trie_counts_weighs_runs(spark, shard):
    rng = random.Random(shard)
    runs = {tuple(rng.randint(1, 4) for _ in range(rng.randint(2, 4))): rng.randint(1, 1 << 40) for _ in range(80)}
    runs[1, 1, 1, 1] = 7
    want = collections.Counter()
    for w, n in runs.items():
        want.update({w[:k]: n for k in range(2, len(w) + 1)})
    df = spark.createDataFrame([(*w, *[0] * (4 - len(w)), n) for w, n in runs.items()], "w1 long, w2 long, w3 long, w4 long, n long")
    got = trie_counts(df, shard).collect()
    assert {tuple(x for x in r[1:5] if x): r["a"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("vocabulary", "n"), [(1, 1), (3, 40), (40, 500), (3000, 20_000)])
def test_trie(vocabulary, n):
    rng = np.random.default_rng(n)
    code = rng.integers(1, 1 << 63, vocabulary, dtype=np.uint64)
    length = rng.integers(2, 5, n)
    words = np.unique(np.where(np.arange(4) < length[:, None], code[rng.zipf(1.3, (n, 4)) % vocabulary], 0).astype(np.uint64), axis=0)
    text, piece = code[rng.zipf(1.3, 3000) % vocabulary], np.sort(rng.integers(0, 300, 3000))
    built, got = trie(words), collections.Counter()
    for rows in built.accepted(built.ids(text), piece):
        got.update(tuple(int(built.labels[x]) for x in built.sequences[r] if x >= 0) for r in rows.tolist())
    want, listed = collections.Counter(), {tuple(int(x) for x in w if x) for w in words}
    for i in range(3000):
        for k in (2, 3, 4):
            run = tuple(text[i : i + k].tolist())
            if i + k <= 3000 and piece[i] == piece[i + k - 1] and run in listed:
                want[run] += 1
    assert got == want


def test_bitmap(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(-(1 << 62), 1 << 62, 5000)
    made = bitmap(spark.createDataFrame([(int(c),) for c in codes] + [(None,)], "h long"), most_bits=17)
    assert made.bits == 17 and made.has(codes).all()
    assert made.has(rng.integers(-(1 << 62), 1 << 62, 5000)).mean() < 0.06
    assert not bitmap(spark.createDataFrame([], "h long")).has(codes).any()
