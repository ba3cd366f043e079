"""Trained operators: learning on the training rows alone, held-out accuracy, and odd rows."""

from __future__ import annotations

import collections
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest

from mlwatch.llm import batches, lm_score, quality_model, recurrent, toxicity
from mlwatch.llm.queries import QUERIES
from tests.llm.conftest import words


def rest(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


@pytest.fixture(scope="module")
def labelled_folder(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("labelled"))
    vocabulary = ["".join(rng.choice("abdefimnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["grobian", "wicht", "lump"]
    docs, labels = [], []
    for i in range(600):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(15, 120))]
        toxic, low = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(1 + len(own) // 20):
                word = rng.choice(bad)
                own[rng.randrange(len(own))] = word if i % 3 else word.replace("o", "0").replace("i", "1")
        if low:
            own = [w + "$$$" for w in own]
        docs.append((i, " ".join(own), f"s{i % 3}", 1.0))
        if i % 10 != 7:
            labels.append((i, int(not low), int(toxic)))
    docs += [(1000, None, None, None), (1001, "", "s0", None), (None, "some text", "s1", 2.0), (5, docs[5][1], "s2", 1.0)]
    labels += [(1001, 1, 0), (None, 1, 1), (3, None, None), (4000, 0, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, score double").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, labels


@pytest.fixture
def unlabelled_folder(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name,column,limit", [("op2_toxicity", 2, 0.5), ("op6_quality", 1, 0.3)])
def test_classifiers(spark, labelled_folder, unlabelled_folder, name, column, limit):
    folder, docs, labels = labelled_folder
    got = QUERIES[name](spark, folder).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d[0] for d in docs)
    for r in got:
        assert r.held_out == (rest(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    truth = {x[0]: x[column] for x in labels if x[0] is not None and x[column] is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id < 1000]
    assert len(held) > 60 and np.mean([a == b for a, b in held]) > 0.95
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in QUERIES[name](spark, folder).collect()}
    assert QUERIES[name](spark, unlabelled_folder).collect() == []


def test_held_out_labels_are_not_read(spark, labelled_folder, tmp_path):
    folder, docs, labels = labelled_folder
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    turned = [(i, q if rest(i, 5) or q is None else 1 - q, t if rest(i, 5) or t is None else 1 - t) for i, q, t in labels]
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op2_toxicity", "op6_quality"):
        a, b = ({(r.doc_id, r.score) for r in QUERIES[name](spark, f).collect()} for f in (folder, str(tmp_path)))
        assert a == b


def test_folding_and_exceptions():
    assert toxicity.fold("M0R0N!") == toxicity.fold("moron ")
    assert toxicity.fold("іdіot") == toxicity.fold("idiot") == toxicity.fold("1d1ot") == toxicity.fold("id!ot")
    lexicon = toxicity.Lexicon({"\x02trash\x03": 5.0, "\x02mor": 2.0, "\x02moron": 4.0}, frozenset({"\x02trash\x03\x02can\x03"}), (0.0, 1.0, 0.0, 0.0, 0.0))
    assert lexicon.weigh(toxicity.fold("trash")) == (5.0, 1)
    assert lexicon.weigh(toxicity.fold("a trash can")) == (0, 0)
    assert lexicon.weigh(toxicity.fold("Trash. moronic more")) == (11.0, 3)
    long, short = lexicon.shape("trash " + "word " * 500), lexicon.shape("trash word")
    assert long[1] < short[1]


def test_word_hashes():
    texts = ["", "a", "A bc\t\tD", " \n", "é漢 x", "bc", "x" * 300]
    import pyarrow as pa

    raw, at = batches.text_bytes(pa.array([*texts, None]))
    start, end, h, rows = batches.words(raw, at)
    found = [[raw[s:e].tobytes() for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in zip(rows[:-1], rows[1:], strict=True)]
    assert found == [words(t, fold=False) for t in [*texts, None]]
    by_word = collections.defaultdict(set)
    for s, e, x in zip(start, end, h.tolist(), strict=True):
        by_word[raw[s:e].tobytes().lower()].add(x)
    assert all(len(v) == 1 for v in by_word.values()) and len({x for v in by_word.values() for x in v}) == len(by_word)


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = recurrent.Network(recurrent.Layout.by_frequency(np.arange(20, 0, -1) * 10, 3, 5), 8)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    ids, targets = rng.integers(0, 23, (2, 6, 4))
    fresh, valid, h = rng.random((6, 4)) < 0.3, rng.random((6, 4)) < 0.8, rng.normal(size=(4, 8))

    def loss():
        states, _ = net.unroll(ids, fresh, h)
        flat = valid.reshape(-1)
        return -net.loss(states.reshape(-1, 8)[flat], targets.reshape(-1)[flat])[0].sum()

    g = net.gradients(ids, targets, fresh, valid, h)[0]
    for k in net.NAMES:
        a = getattr(net, k)
        for _ in range(10):
            i = tuple(rng.integers(0, s) for s in a.shape)
            old, step = a[i], 1e-3
            a[i] = old + step
            up = loss()
            a[i] = old - step
            down = loss()
            a[i] = old
            assert abs((up - down) / (2 * step) - g[k][i]) < 5e-3 * max(1, abs(g[k][i]))


def test_state_carries_over_windows(monkeypatch):
    rng = np.random.default_rng(1)
    net = recurrent.Network(recurrent.Layout.by_frequency(np.arange(30, 0, -1), 2, 5), 8)
    size = rng.integers(0, 40, 20)
    symbols, offsets = rng.integers(0, 32, size.sum()).astype(np.int32), np.concatenate([[0], np.cumsum(size)])
    whole = recurrent.log_likelihood(net, symbols, offsets, 0)
    monkeypatch.setattr(recurrent, "SCORE_STEPS", 3)
    assert np.allclose(whole, recurrent.log_likelihood(net, symbols, offsets, 0, most=4), rtol=1e-4)
    # probabilities of all that can come next add up to one
    state = rng.normal(size=(1, 8)).astype(np.float32)
    assert math.isclose(sum(math.exp(net.loss(state, np.array([t]))[0][0]) for t in range(32)), 1, rel_tol=1e-4)


def test_a_long_text_among_short_ones_needs_no_more_memory_than_its_words():
    net = recurrent.Network(recurrent.Layout.by_frequency(np.arange(30, 0, -1), 2, 5), 4)
    size = np.array([5] * 300 + [20_000])
    symbols, offsets = np.random.default_rng(2).integers(0, 32, size.sum()).astype(np.int32), np.concatenate([[0], np.cumsum(size)])
    for run in (lambda: recurrent.log_likelihood(net, symbols, offsets, 0), lambda: recurrent.fit(net, symbols, offsets, 0, 0.02, 0.3)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 10 << 20


def test_lm_query(spark, rows, folder, empty_folder):
    got = QUERIES["op3_lm_score"](spark, folder).collect()
    tokens = [[*words(r[1]), None] for r in rows]
    counts = collections.Counter(t for r, own in zip(rows, tokens, strict=True) if rest(r[0], 7) != 2 for t in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(r[0]), rest(r[0], 7) == 2, len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 6))
        for r, own in zip(rows, tokens, strict=True)
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert QUERIES["op3_lm_score"](spark, empty_folder).collect() == []


def test_lm_words_beyond_the_list(spark, rows, folder, monkeypatch):
    full = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in QUERIES["op3_lm_score"](spark, folder).collect()}
    monkeypatch.setattr(lm_score, "LISTED", 40)
    monkeypatch.setattr(lm_score, "WORDS", 20)
    short = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in QUERIES["op3_lm_score"](spark, folder).collect()}
    assert short == full


def test_lm_learns_from_every_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three w{i % 7} four") for i in range(50)], "deal long, text string")
    counts = lm_score.settled(lm_score.word_counts(docs))
    learned = []
    monkeypatch.setattr(lm_score, "PART_TOKENS", 100, raising=False)
    average = lm_score.average
    monkeypatch.setattr(lm_score, "average", lambda vectors: (learned.append(vectors.where("piece = 0").collect()), average(vectors))[1])
    model = lm_score.train(docs, counts)
    # a part weighs its words and its texts and one more
    assert [sum(r.weight - 1 for r in x) for x in learned] == [50 * 5 + 50] and len(learned[0]) == 3
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert (lm_score.train(docs, counts).network == model.network).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_leader_is_deterministic():
    texts, labels = ["good words here.", "bad*** words***", "more good words.", "###"] * 5, np.array([1, 0, 1, 0] * 5)
    a, b = (quality_model.leader(texts, labels, 0.3, 1.0, 0.02, 0.0, 5) for _ in range(2))
    assert (a.weights == b.weights).all()
    scores = [a.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts[:4]]
    assert min(scores[0], scores[2]) > 0.5 > max(scores[1], scores[3])


def listing(hashes):
    layout = recurrent.Layout.by_frequency(np.arange(4, 0, -1), lm_score.GROUPS, 2)
    n = np.ones(len(hashes), np.int64)
    return lm_score.Model(hashes, n, np.arange(len(hashes)) % 5 - 1, 1, 1, n[:0], n[:0], np.zeros(0, np.float32), layout, 2)


def test_lookup_finds_the_listed_words_without_a_search():
    rng = np.random.default_rng(3)
    hashes = np.unique(np.append(rng.integers(0, 1 << 64, 1 << 17, dtype=np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64)))
    asked = np.concatenate([rng.choice(hashes, 300_000), rng.integers(0, 1 << 64, 300_000, dtype=np.uint64), hashes + np.uint64(1), hashes[:1], hashes[-1:]])
    model = listing(hashes)
    listed, at = model.lookup(asked)
    assert (listed == np.isin(asked, hashes)).all() and (hashes[at[listed]] == asked[listed]).all()

    def seconds(run):
        took = []
        for _ in range(5):
            begun = time.process_time()
            run()
            took.append(time.process_time() - begun)
        return min(took)

    assert seconds(lambda: model.lookup(asked)) < 0.6 * seconds(lambda: np.searchsorted(hashes, asked))
    # hashes that share their first bits, and lists of one and of none
    close = np.arange(5, 400, 3, dtype=np.uint64)
    for few in (close, close[:1], close[:0]):
        listed, at = listing(few).lookup(np.arange(500, dtype=np.uint64))
        assert np.flatnonzero(listed).tolist() == few.tolist() and (few[at[listed]] == few).all()


def test_sums_by_id_and_tallies():
    rng = np.random.default_rng(4)
    for ids in (rng.zipf(1.3, 3_000) % 500, np.array([70_000, 2, 70_000]), np.zeros(40, int), np.empty(0, int)):
        rows = rng.normal(size=(len(ids), 6))
        found, sums = recurrent.sums_by_id(ids, rows)
        want = np.zeros((70_001, 6))
        np.add.at(want, ids, rows)
        assert sorted(found.tolist()) == sorted(set(ids.tolist())) and np.allclose(sums, want[found])
        h, g, n = lm_score.tallied(ids.astype(np.uint64), (ids % 7).astype(np.int8))
        assert dict(zip(h.tolist(), n.tolist(), strict=True)) == collections.Counter(ids.tolist()) and (g == h % 7).all()


def test_far_logits_neither_overflow_nor_vanish():
    net = recurrent.Network(recurrent.Layout.by_frequency(np.arange(20, 0, -1), 3, 5), 8)
    states, targets = np.full((23, 8), 0.5, np.float32), np.arange(23)
    near = net.loss(states, targets)[0]
    for shift in (-300, 300):
        far = recurrent.Network(net.layout, 8).load(net.vector())
        far.bc += np.float32(shift)
        far.bo += np.float32(shift)
        assert np.allclose(far.loss(states, targets)[0], near, atol=1e-3)


def test_lm_copies_have_the_scores_of_one(spark):
    texts = ["the sea was calm", None, "", "zzz qqq zzz the sea"]
    once = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    more = spark.createDataFrame([(i + 10 * c, t) for i, t in enumerate(texts) for c in range(4)], "doc_id long, text string")
    learn = lm_score.F.col("doc_id") == 0
    want = {r.doc_id: r for r in lm_score.score(once, learn).collect()}
    got = lm_score.score(more, learn).collect()
    assert len(got) == 16
    for r in got:
        one = want[r.doc_id % 10]
        assert (r.n_tokens, r.n_known) == (one.n_tokens, one.n_known)
        assert math.isclose(r.base_score, one.base_score, rel_tol=1e-9) and math.isclose(r.score, one.score, rel_tol=1e-5)
