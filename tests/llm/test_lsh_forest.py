"""The forest's components against all pairs, and its parts against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from mlwatch.llm import lsh_forest
from mlwatch.llm.lsh_forest import near_duplicates, values_of
from tests.llm.conftest import words


def plain(rows, k=2, percent=80):
    """(id, size of set, component, kept) by comparing all pairs."""
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        component = least.get(find(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return out


def same(got, want):
    return sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_against_plain(docs, rows):
    assert same(near_duplicates(docs).collect(), plain(rows))


def test_dense_regions(spark, monkeypatch):
    """Families that share half their shingles make regions too dense to compare, so that several rounds are needed."""
    monkeypatch.setattr(lsh_forest, "MINOR", 2)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(3):
        base = rng.choices(vocabulary, k=60)
        for _ in range(40):
            own = [w if rng.random() < 0.72 else rng.choice(vocabulary) for w in base]
            rows.append((len(rows), " ".join(own)))
            if rng.random() < 0.3:
                own[rng.randrange(60)] = "changed"
                rows.append((len(rows), " ".join(own)))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rounds = []
    once = lsh_forest.searched
    monkeypatch.setattr(lsh_forest, "searched", lambda *a: rounds.append(1) or once(*a))
    assert same(near_duplicates(made).collect(), plain(rows))
    assert len(rounds) > 1


def test_many_copies(spark):
    text = " ".join(f"w{i}" for i in range(300))
    near = [" ".join(f"w{i}" if i != k else "other" for i in range(300)) for k in range(250)]
    rows = [(i, text) for i in range(3000)] + [(5000 + i, t) for i, t in enumerate(near)] + [(9000, text + " x" * 200_000), (9001, None), (9002, " \n")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.component_id for r in got if r.doc_id < 9000} == {0}
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id >= 9000} == {(9000, 0, False), (9001, 9001, True), (9002, 9002, True)}
    assert sum(r.kept for r in got) == 3


def test_signatures_and_pairs_have_tasks_for_their_rows(docs, spark, many_partitions):
    found = lsh_forest.signatures(docs, "text", 2, 0)
    assert found.rdd.getNumPartitions() == 1
    none = spark.createDataFrame([], "node long, root long")
    missed = found.selectExpr("cls", "0D AS missed")
    pairs, missed = lsh_forest.searched(found, none, missed, 80)
    assert pairs.count() and pairs.rdd.getNumPartitions() == missed.rdd.getNumPartitions() == 1


def test_empty(empty):
    assert near_duplicates(empty).collect() == []


@pytest.mark.parametrize("percent", [70, 80])
def test_other_limits(docs, rows, percent):
    assert same(near_duplicates(docs, k=1, percent=percent).collect(), plain(rows, 1, percent))


def test_values_estimate_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 1 << 48, n, dtype=np.uint64) for n in (800, 100, 100))
    values = values_of(np.concatenate([both, a, both, b]), np.array([900, 0, 900]), 3)
    assert values.shape == (2, lsh_forest.VALUES) and abs((values[0] == values[1]).mean() - 0.8) < 0.2
