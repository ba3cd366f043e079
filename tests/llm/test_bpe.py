"""The encoder against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mlwatch.llm import bpe
from mlwatch.llm.queries import QUERIES, WORD_BPE

PATH = public_tokenizers.path(WORD_BPE)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(1)
    signs = "aZé ΣςİßÅÁ \u0085\x1c\x1d​　漢字カ12½Ⅷ’'s'LL!?😀ﬁǅͅÉＡ\t\n\r\x0b "
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    special = ["<|endoftext|>hi<|startoftext|><|endoftext|> x", "a<|endoftext|>", "<|endoftext", "a<b", "<|ENDOFTEXT|>"]
    return [*made, *special, "it's he'll I'M", "ΑΣ ΑΣ. ὈΔΥΣΣΕΎΣ", "", " ", "x" * 5000, "ab " * 5000]


def test_as_the_library(library):
    codec, texts = bpe.Codec(PATH), odd_texts()
    ids = codec.encode_batch(texts)
    for text, own, back in zip(texts, ids.to_pylist(), codec.decode_batch(ids).to_pylist(), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert own == want, text
        assert back == library.decode(want, skip_special_tokens=False)


def test_small_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 2)
    codec = bpe.Codec(PATH)
    for text in odd_texts()[:200]:
        assert codec.encode_batch([text]).to_pylist()[0] == library.encode(text, add_special_tokens=False).ids


def test_query(spark, rows, folder, library):
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), back))))
    got = QUERIES["op1_bpe"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_general_interface(docs, rows, spark, empty, empty_folder):
    out = bpe.decode(bpe.encode(docs.withColumnRenamed("lang", "ids"), PATH), PATH)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "key", "cls", "ids", "decoded"]
    assert out.where("text IS NULL").first().ids == [] and out.where("text IS NULL").first().decoded == ""
    assert out.count() == len(rows)
    assert QUERIES["op1_bpe"](spark, empty_folder).collect() == []


def test_memory_is_empty_behind_a_task(spark):
    class Frame:
        columns, schema = ["text"], None
        drop = select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    batch = pa.RecordBatch.from_pydict({"text": ["some words here", "and here"]})
    for make in (bpe.encode, bpe.round_trip):
        assert sum(b.num_rows for b in make(Frame(), PATH)(iter([batch]))) == 2
        own = bpe.codec(PATH)
        assert len(own.new) == 1 and not (own.old or own.new_pieces or own.old_pieces)
