"""Winnowing against a plain version, row by row."""

from __future__ import annotations

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from mlwatch.llm import queries, winnow

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def turn(x, by):
    by %= 64
    return ((x << by) | (x >> (64 - by))) & MASK if by else x


def plain(text, k=5, window=8):
    units = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    h = [xxhash.xxh64(u.encode(), seed=42).intdigest() for u in units]
    grams = []
    for i in range(max(len(h) - k + 1, min(1, len(h)))):
        value = 0
        for j in range(k):
            value ^= turn(h[i + j] if i + j < len(h) else 0, k - 1 - j)
        grams.append(signed(value))
    out = []
    for i in range(max(len(grams) - window + 1, min(1, len(grams)))):
        part = grams[i : i + window]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1][1] != at:
            out.append((grams[at], at))
    return out


def jaccard(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = [
    "", None, " \n", "one", "one two three", "a b c d e f g h i j k l m n o p q r s t", "a a a a a a a a a a a a a a a a a a a a",
    "x" * 100, "é ü ß " * 40, "a\tb\x0bc d " * 9,
]


@pytest.mark.parametrize("k,window", [(1, 1), (2, 3), (5, 8), (6, 4)])
def test_fingerprint(spark, k, window):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = df.select("i", winnow.fingerprint(F.col("text"), k, window).alias("f")).collect()
    for r in got:
        assert [tuple(x) for x in r.f] == plain(TEXTS[r.i], k, window)


def test_shared_run_is_found(spark):
    shared = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(f"p q r {shared} s", f"z {shared} y x v u")], "a string, b string")
    one = df.select(winnow.fingerprint(F.col("a")).alias("a"), winnow.fingerprint(F.col("b")).alias("b")).first()
    common = {h: p for h, p in one.a}.keys() & {h: p for h, p in one.b}.keys()
    assert common
    assert {dict(one.a)[h] - dict(one.b)[h] for h in common} == {2}


@pytest.mark.parametrize("rows", [[], [(7, "only one here")], [(i % 50 if i % 9 else None, f"t {i} " * (i % 7)) for i in range(200)]])
def test_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op4_winnow"](spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=key) == sorted(want, key=key)
    by_text = {}
    for r in got:
        assert by_text.setdefault((r.n_chars, r.edited_sha256), r.edited_fingerprint) == r.edited_fingerprint
