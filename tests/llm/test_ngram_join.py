"""The similarity join against a comparison of all pairs."""

from __future__ import annotations

import collections

import numpy as np

from mlwatch.llm import ngram_join
from mlwatch.llm.components import components
from mlwatch.llm.queries import QUERIES
from tests.llm.conftest import words


def sets_of(rows, k=5):
    out = []
    for r in rows:
        w = words(r[1])
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def plain(rows, percent=75):
    sets = sets_of(rows)
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return [(r[0], len(sets[i]), (min(least[root(i)], default=None) if sets[i] else r[0])) for i, r in enumerate(rows)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_components_of_rows(docs, rows, folder, spark):
    want = ordered(plain(rows))
    assert ordered(QUERIES["op10_ngram_join"](spark, folder).collect()) == want
    assert len({c for _, n, c in want if n}) > 40 and max(collections.Counter(c for _, n, c in want).values()) > 15


def test_other_limit(docs, rows):
    assert ordered(ngram_join.similarity_components(docs, percent=60).collect()) == ordered(plain(rows, 60))


def test_empty(spark, empty, empty_folder):
    assert QUERIES["op10_ngram_join"](spark, empty_folder).collect() == []
    assert ngram_join.representatives(empty).collect() == []


def test_representatives(docs, rows):
    got = ngram_join.representatives(docs).collect()
    plan = plain(rows)
    with_words = {c for _, n, c in plan if n}
    assert sorted(r.doc_id for r in got if (r.text or "").split()) == sorted(with_words)
    assert sum(not (r.text or "").split() for r in got) == sum(not n for _, n, _ in plan)
    assert got[0].asDict().keys() == dict(zip(docs.columns, rows[0], strict=True)).keys()


def test_chain_through_middle_members(spark):
    # neighbours are similar, the ends are not: only links through the middle join them
    rows = [(100 - i, " ".join(f"w{j}" for j in range(4 * i, 4 * i + 60))) for i in range(12)]
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {89}


def test_a_template_with_too_much_of_its_own_makes_no_pairs(spark, monkeypatch):
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    template = " ".join(f"t{j}" for j in range(84))
    rows = [(i, f"{template} {own(i, 20)}") for i in range(30)]  # 80 shared shingles of 100, two are 80 of 120 alike
    sent, plain_verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: (sent.append(pairs.count()), plain_verified(pairs, *rest))[1])
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(plain(rows)) and sum(sent) == 0
    rows += [(30 + i, f"{template} {own(i, 1)}") for i in range(3)]  # these are similar to all
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(plain(rows)) and len({r.component_id for r in got}) == 1


def test_prefixes_are_compared_before_token_lists_move(spark):
    found = spark.createDataFrame([(1, [5], [7]), (2, [5, 6], [8]), (3, [5], [7, 9])], "cls long, by_b array<long>, by_c array<long>")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a long, b long")
    assert ngram_join.sharing_prefixes(pairs, found).collect() == [(3, 1)]


def test_groups_follow_the_tokens(docs, rows, monkeypatch):
    used, survivors = [], ngram_join.survivors
    monkeypatch.setattr(ngram_join, "survivors", lambda *x: (used.append(x[-1]), survivors(*x))[1])
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 500, raising=False)
    assert ordered(ngram_join.similarity_components(docs).collect()) == ordered(plain(rows))
    assert used == [-(-sum(n for _, n, _ in plain(rows)) // 500)] and used[0] > 4


def test_screen_keeps_every_class_with_a_partner(docs, rows, spark):
    sets = sets_of(rows)
    linked = lambda i: any(j != i and a != sets[i] and 100 * len(a & sets[i]) >= 75 * len(a | sets[i]) for j, a in enumerate(sets))
    partners = {sets[i] for i in range(len(rows)) if sets[i] and linked(i)}
    sized = ngram_join.rows_with_class(docs.select("text"), "text", 5).select("text", "n_shingles", "cls").cache()
    wanted, share = ngram_join.screened(docs, sized, "text", 5, 75)
    got = sized.collect()
    kept = {s for r in got for s in sets_of([(0, r.text)]) if wanted.has(np.array([r.cls]))[0]}
    assert partners <= kept and len(partners) > 20
    assert len(kept) < len({s for s in sets if s}) / 2 + len(partners) and 0 < share < 1


def test_lone_classes_send_their_first_tokens_only(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(60)]
    rows += [(100 + i, " ".join(f"near{j}" for j in range(i, 400 + i))) for i in range(3)]
    sent, plain_shared = [], ngram_join.posted
    monkeypatch.setattr(ngram_join, "posted", lambda *x: (out := plain_shared(*x), sent.append(sum(len(r.blob) for r in out.collect())))[0])
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id >= 100} == {100} and len({r.component_id for r in got}) == 61
    assert sum(sent) < 63 * 396 * 6


def test_small_steps_have_tasks_for_their_rows(spark, many_partitions):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert components(edges).rdd.getNumPartitions() == 1


def test_settled_frames_have_files_for_their_rows(docs, many_partitions, monkeypatch):
    # a file of a checkpoint is a process of its own on a local disk, and a request to any shared store
    parts, plain_settled = [], ngram_join.settled
    record = lambda df: (out := plain_settled(df), parts.append(out.rdd.getNumPartitions()))[0]
    monkeypatch.setattr(ngram_join, "settled", record)
    monkeypatch.setattr("mlwatch.llm.components.settled", record)
    ngram_join.similarity_components(docs).collect()
    assert len(parts) > 10 and sum(p == 37 for p in parts) <= 1 and sum(parts) < 37 + 3 * len(parts)


def test_only_classes_in_pairs_send_prefixes(spark):
    far = [(i * 0x9E3779B97F4A7C15 % (1 << 63), [i], [i]) for i in range(1, 2000)]
    found = spark.createDataFrame(far, "cls long, by_b array<long>, by_c array<long>")
    pairs = spark.createDataFrame([(far[0][0], far[1][0]), (far[2][0], far[1][0]), (far[0][0], None)], "a long, b long")
    got = {r.cls for r in ngram_join.in_pairs(found, pairs).collect()}
    assert {far[0][0], far[1][0], far[2][0]} <= got and len(got) < 100
    assert ngram_join.in_pairs(found, pairs.limit(0)).collect() == []


def test_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 100}
