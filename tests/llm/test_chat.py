"""Event folding and the template, against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from mlwatch.llm import chat
from mlwatch.llm.queries import PLANTED, QUERIES

NASTY = ["", None, "\\", "<|", "<\\|", "\\<|turn|>", "<|turn|>user\n<|end|>\n", "<|end|>", "<", "|", "<<|", "\\n", "<\\n>", "é漢😀", "a\nb\n", PLANTED]
SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def make_rows():
    rng = random.Random(2)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 9)):
            text = "".join(rng.choice(NASTY) or "" for _ in range(rng.randint(0, 4))) if turn % 2 else rng.choice(NASTY)
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a\nb<|", None]), text, turn))
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 5), None) for t in range(500)]
    return [*rows, rows[3], (None, None, "assistant", "lost", 1)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    out = []
    rows = [*[r[:4] for r in rows], (-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)]
    order = lambda r: (str(r[0]), r[1] if r[1] is not None else -1, r[3] or "")
    for conv, own in itertools.groupby(sorted(rows, key=order), key=lambda r: r[0]):
        own = [(r or "", t or "") for _, _, r, t in own]
        learnt = "".join(t for r, t in own if r == "assistant")
        out.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(learnt), sha(learnt)))
    return out


def test_query(spark, tmp_path):
    rows = make_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r)[:5] for r in QUERIES["op5_chat"](spark, str(tmp_path)).collect()]
    # roles of equal turns with equal texts may come in either order; the fixture's repeated row has one role
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r)[:2] for r in QUERIES["op5_chat"](spark, str(tmp_path)).collect()] == [(-1, 2)]


def test_escape_is_reversible(spark):
    texts = ["".join(p) for n in range(5) for p in itertools.product("\\<|n", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.t == r.u and "<|" not in r.e
    roles = df.select("t", chat.escape_role(F.concat("t", F.lit("\n"), "t")).alias("e")).withColumn("u", chat.unescape_role(F.col("e")))
    for r in roles.collect():
        assert r.u == f"{r.t}\n{r.t}" and "\n" not in r.e


def test_folding(spark):
    events = [
        (1, 0, 1, "message", "user", "hi"),
        (1, 1, 2, "message", "assistant", None), (1, 1, 3, "delta", None, "wr"), (1, 1, 4, "delta", None, "ong"),
        (1, 1, 5, "regenerate", None, None), (1, 1, 7, "delta", None, "ght"), (1, 1, 6, "delta", None, "ri"),
        (1, 2, 8, "message", "user", "first"), (1, 2, 9, "edit", None, "second"), (1, 2, 10, "delta", None, "!"),
        (1, 3, 11, "delta", "assistant", "no start"),
        (1, 4, 12, "message", "user", "twice"), (1, 4, 12, "message", "user", "twice"),
    ]
    df = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string").repartition(5)
    got = chat.messages(df).orderBy("turn", "place").collect()
    assert [(r.turn, r.role, r.text) for r in got] == [
        (0, "user", "hi"), (1, "assistant", "right"), (2, "user", "second!"), (3, "assistant", "no start"), (4, "user", "twice"), (4, "user", "twice"),
    ]
    with pytest.raises(Exception, match="unknown kind"):
        chat.messages(df.withColumn("kind", F.lit("other"))).collect()


def test_mask_lies_on_the_texts(spark):
    rows = [(1, 0, "user", "é<|"), (1, 1, "assistant", "漢<|end|>\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    r = chat.render(df).first()
    raw = r.formatted.encode()
    assert [raw[s.start : s.start + s["size"]].decode() for s in r.loss] == ["漢<\\|end|>\\\\"]
