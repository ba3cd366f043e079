"""The mix against a plain version in Python and in SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from mlwatch.llm import mixing
from mlwatch.llm.queries import QUERIES, SQL
from tests.llm.conftest import words


def plain_targets(sizes, cap=3.0):
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, full = sum(sizes.values()), set()
    while total:
        rest = total - sum(cap * sizes[s] for s in full)
        free = sum(w for s, w in weights.items() if s not in full)
        over = {s for s in sizes if s not in full and cap * sizes[s] < weights[s] * rest / free}
        if not over:
            return {s: cap * sizes[s] if s in full else weights[s] * rest / free for s in sizes}
        full |= over
    return dict.fromkeys(sizes, 0.0)


def test_query(spark, rows, folder):
    got = QUERIES["op9_mix"](spark, folder).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want = plain_targets(sizes)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in by_id[r.doc_id] if len(words(x[1])) == r["size"]]
        assert any(sizes[x[3]] == r.source_size and math.isclose(want[x[3]], r.target) for x in own)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, QUERIES["op9_mix"](spark, folder).collect()), key=str)


def test_query_as_sql(spark, folder):
    con = duckdb.connect()
    # SQL has no text for a null id in its hash
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    want = con.execute(SQL["op9_mix"]).fetchall()
    spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL").write.parquet(f"{folder}/b/documents.parquet")
    got = QUERIES["op9_mix"](spark, f"{folder}/b").select("doc_id", "size", "source_size", "target", "copies", "taken").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 1, "b": 1000}, {"a": 0, "b": 10}, {"a": 0}, {None: 5, "z": 5, "é": 7, "Z": 100}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(mixing.cyclic_weights(df)).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in got)


def test_taken_near_targets_and_emitted(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "id % 50 AS size", "1 AS copies")
    planned = mixing.copies(df, mixing.cyclic_weights(mixing.source_sizes(df)))
    for r in planned.groupBy("source").agg({"target": "max", "size": "sum"}).collect():
        taken = planned.where(planned.source == r.source).selectExpr("sum(size * copies)").first()[0]
        assert abs(taken - r["max(target)"]) < 0.15 * r["max(target)"]
    assert mixing.emit(planned).count() == planned.selectExpr("sum(copies)").first()[0]


def test_empty(spark, empty_folder):
    assert QUERIES["op9_mix"](spark, empty_folder).collect() == []


def test_settled_frames_have_files_for_their_sources(spark, rows, many_partitions, monkeypatch):
    parts, plain_settled = [], mixing.settled
    monkeypatch.setattr(mixing, "settled", lambda df: (out := plain_settled(df), parts.append(out.rdd.getNumPartitions()))[0])
    df = mixing.word_count(spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, source string"))
    mixing.copies(df, mixing.cyclic_weights(mixing.source_sizes(df))).collect()
    assert len(parts) == 4 and sum(parts) <= 37 + 3
