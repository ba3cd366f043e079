"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mlwatch.llm import mixing, ngram_join, quality_model
from mlwatch.llm import repeats as repeats_module
from mlwatch.llm.labelled import remainder
from tests.llm.test_ngram_join import plain as components
from tests.llm.test_repeats import plain as repeats


def test_stages(spark, docs, rows, tmp_path):
    labels = [(r[0], int(r[0] % 5 != 0), 0) for r in rows if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mix", "encode"]
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append(now.collect())

    model = quality_model.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), remainder("doc_id", 5) != 0)
    scored = quality_model.score(docs, model, into="own").where("own >= 0.3").drop("own").collect()
    assert collections.Counter(map(str, scored)) == collections.Counter(map(str, kept[1]))

    groups = components([tuple(r) for r in kept[1]])
    assert sum(bool((r.text or "").split()) for r in kept[2]) == len({c for _, n, c in groups if n})
    assert sum(not (r.text or "").split() for r in kept[2]) == sum(not n for _, n, _ in groups)

    gone = {r[0]: r for r in repeats([tuple(r) for r in kept[2]])}
    before = collections.Counter(r.doc_id for r in kept[2])
    for r in kept[3]:
        if before[r.doc_id] == 1:
            if not gone[r.doc_id][2]:
                assert any(r == x for x in kept[2])
            else:
                assert r.n_chars == len(r.text) and 0 <= gone[r.doc_id][1] - gone[r.doc_id][2] - len(r.text.encode()) <= 6 * gone[r.doc_id][3]
    assert collections.Counter(r.doc_id for r in kept[3]) == before

    assert set(map(str, kept[4])) <= set(map(str, kept[3]))
    assert max(collections.Counter(map(str, kept[4])).values()) <= 3 * max(collections.Counter(map(str, kept[3])).values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = collections.Counter(tuple(library.encode(r.text or "", add_special_tokens=False).ids) for r in kept[4])
    assert collections.Counter(tuple(r.ids) for r in kept[5]) == want


NAMES = "_score _size _found _cls _place _stays _id _n _source _facts _lines _stay _key _to _at _extra next _s _plan score size copies target source_size spans rest kept n_bytes cls key id"


def test_other_columns_keep_values_and_types(spark, docs, tmp_path):
    """Extra columns that have the names of any operator's own ones come out of every stage as they went in."""
    extra = NAMES.split()
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    marked = plain.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in extra})
    marked.write.parquet(f"{tmp_path}/marked")
    marked = spark.read.parquet(f"{tmp_path}/marked")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, marked, str(tmp_path))
        assert out.dtypes == marked.dtypes, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in extra), name
        want = collections.Counter(str(r) for r in stage(spark, plain, str(tmp_path)).select("doc_id", "n_chars").collect())
        assert collections.Counter(str(r) for r in out.select("doc_id", "n_chars").collect()) == want, name


@pytest.mark.parametrize("add", [lambda d: ngram_join.representatives(d), lambda d: repeats_module.remove_repeats(d), lambda d: mixing.copies(mixing.word_count(d), mixing.cyclic_weights(mixing.source_sizes(mixing.word_count(d))))])
def test_operators_keep_columns_of_any_name(spark, docs, add, tmp_path):
    """The names that are not those of an operator's results."""
    extra = [c for c in NAMES.split() if c not in ("size", "copies", "target", "source_size", "spans", "rest", "kept", "n_bytes")]
    plain = docs.select("doc_id", "text", "source")
    plain.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in extra}).write.parquet(f"{tmp_path}/marked")
    rows = add(spark.read.parquet(f"{tmp_path}/marked")).collect()
    assert rows and all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in extra)


def test_run(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.where("doc_id < 12").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
