"""A small table of documents with everything that can be odd about one."""

from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, fold=True):
    raw = (text or "").encode()
    return WORD.findall(raw.translate(FOLD) if fold else raw)


def make_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéñ漢") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(300), say(60)
    texts = [None, "", " \n\t ", "one", "One", "two words", "a b c d", "a b c d", "x" * 700, "ab" * 300, "\x00\x01 z"]
    texts += [base, base, base.upper(), base.lower()]
    for k in range(1, 40):  # near copies at all distances
        own = base.split(" ")
        for _ in range(k % 20):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [f"{say(rng.randint(0, 80))} {passage}\n{say(rng.randint(0, 80))}" for _ in range(15)]
    texts += ["der " * 400, ("la la li " * 90).strip(), say(4000), f"{say(30)}. {base} {say(2)}"]
    texts += [say(rng.randint(1, 90)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t or ""), "extra", i) for i, t in enumerate(texts)]
    rows += [rows[20], rows[12], (None, base, None, None, None, None, None), (7, say(40), "de", "s1", 3, None, 2)]
    return rows


# names that operators use for their own columns are among the extra ones
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, cls int"


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture
def empty_folder(empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/empty/documents.parquet")
    return f"{tmp_path}/empty"


@pytest.fixture
def many_partitions(spark):
    """More shuffle partitions than rows need, which Spark leaves as they are."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
