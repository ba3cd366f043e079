"""Repeated byte strings against a count of all of them, and the suffix order against sorting."""

from __future__ import annotations

import collections
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlwatch.llm import repeats, suffix_sort
from mlwatch.llm.queries import QUERIES
from mlwatch.llm.repeats import remove_repeats


def plain(rows, size=200):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, rows, folder):
    want = plain(rows)
    assert sorted((tuple(r) for r in QUERIES["op8_repeats"](spark, folder).collect()), key=str) == want
    assert sum(w[2] for w in want) > 5000 and any(w[2] == w[1] for w in want)


@pytest.mark.parametrize("size,gram", [(20, 8), (64, 16)])
def test_sizes(docs, rows, size, gram):
    got = repeats.remove_repeats(docs, size=size, gram=gram).collect()
    own = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    assert own == plain(rows, size)
    for r in got:
        assert r.rest == bytes(r.kept).decode("utf-8", "ignore")


def test_small_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    got = repeats.remove_repeats(docs, size=20, gram=8).collect()
    assert sum(s.end - s.begin for r in got for s in r.spans) == sum(w[2] for w in plain(rows, 20))


def test_hot_anchors_are_not_sorted_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = letters(40)
    rows = [(i, letters(30) + passage + letters(30)) for i in range(600)] + [(600, "a" * 9_000), (601, letters(50))]
    sort = repeats.repeated_starts

    def bounded(texts, times, size):
        assert sum(map(len, texts)) <= 500 + 3_000
        return sort(texts, times, size)

    monkeypatch.setattr(repeats, "repeated_starts", bounded)
    monkeypatch.setattr(repeats, "CHUNK", 500)
    monkeypatch.setattr(repeats, "HOT", 3_000, raising=False)
    monkeypatch.setattr(repeats, "BUFFER", 5_000)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=20, gram=8).collect()
    own = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    assert own == plain(rows, 20)


def test_groups_that_count_get_a_common_anchor_once_from_each_lot(spark):
    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(97, 123, 2_000, dtype=np.uint8)).decode()
    own = [bytes(rng.integers(97, 123, 3_000, dtype=np.uint8)).decode() for _ in range(40)]
    docs = spark.createDataFrame([(i, t + passage) for i, t in enumerate(own)], "key long, text string").coalesce(1)
    sizes = {r.part: np.concatenate([repeats.unpack([r.blob])[1]]) for r in repeats.posted(docs, 200, 32, 8).collect()}
    counted = [v for part, v in sizes.items() if part < 8]
    assert len(counted) == 8 and max(map(len, counted)) < 2 * min(map(len, counted))
    assert all(len(np.unique(v)) == len(v) for v in counted)


def test_empty(spark, empty, empty_folder):
    assert QUERIES["op8_repeats"](spark, empty_folder).collect() == []


@pytest.mark.parametrize("run", [4_000_000, 7])
def test_suffix_order(monkeypatch, run):
    monkeypatch.setattr(suffix_sort, "RUN", run)
    rng = np.random.default_rng(0)
    for trial in range(150):
        a = rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)).astype(np.uint16)
        if trial % 5 == 0:
            a = np.tile(a[: max(1, len(a) // 6)], 6)
        if trial % 7 == 0:
            a = np.concatenate([np.ones(40, np.uint16), a])
        want = sorted(range(len(a)), key=lambda i, a=a: tuple(a[i:]))
        assert suffix_sort.suffix_order(a, np.arange(len(a))).tolist() == want
        some = np.arange(0, len(a), 3)
        assert suffix_sort.suffix_order(a, some).tolist() == [i for i in want if i % 3 == 0]


def test_many_equal_rows(spark):
    """Rows in thousands of copies cost no more than their number."""
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    text, other = say(9000), say(5000)
    part = say(300) + text[2000:2400] + say(300)
    rows = [(1, text)] * 20_000 + [(2, other), (3, part), (4, None), (5, "")] + [(6, "short")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    began = time.time()
    got = {tuple(r) for r in remove_repeats(df).select("doc_id", "n_bytes", F.size("spans"), F.length("kept")).collect()}
    assert time.time() - began < 200
    assert got == {(1, 9000, 1, 0), (2, 5000, 0, 5000), (3, 1000, 1, 600), (4, 0, 0, 0), (5, 0, 0, 0), (6, 5, 0, 5)}
