"""Line rules against SQL, and on lines of every kind."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from mlwatch.llm import line_rules
from mlwatch.llm.queries import QUERIES, SQL

TALK = "the quick brown fox jumps over the lazy dog number {}, and nobody minds at all."


def test_query_as_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(SQL["op7_line_rules"])
    got = QUERIES["op7_line_rules"](spark, folder).select(*[c[0] for c in want.description]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("line,stays", [
    ("Short title", True), ("", False), ("  ", False), (TALK.format(1), True), ("home | about | contact | login page", False),
    ("buy*** now$$$ cheap### deal&&&", False), ("WOW!! BUY!! NOW!! YES!!", False), ("We use cookies here.", False),
    ("na na na na na na na na na na.", False), ("one two three four five six seven eight nine ten eleven", False),
    ("Sign in to read more", False), ("5 > 3 is true for all of us here, he said.", True),
])
def test_lines(spark, line, stays):
    assert spark.createDataFrame([(line,)], "x string").select(line_rules.line_passes(F.col("x"))).first()[0] is stays


def plain_repeats(words):
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)})


def test_repeated_words(spark):
    texts = ["", "a", "a b", "a a a", "a a a a", "a b c a b c", "x a b c y a b c z", "a b a b a b a b", "a b c d e f", None]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, kept int")
    got = {r.text: r.n_repeat_words for r in line_rules.clean(df).collect()}
    assert got == {t: plain_repeats((t or "").split()) for t in texts}


def test_verdicts(spark, empty, empty_folder):
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(8))
    menu = "\n".join("home | about us | contact | imprint | search" for _ in range(30))
    rows = [(good,), (good + "\n" + menu,), (good + "\nhome | about | contact",), (TALK.format(1),), (None,), (good + "\n" + good.split("\n")[3],)]
    got = line_rules.clean(spark.createDataFrame(rows, "text string")).collect()
    assert [r.kept for r in got] == [True, False, True, False, False, True]
    assert [r.n_dup_lines for r in got] == [0, 29, 0, 0, 0, 1]
    assert got[2].cleaned == good and got[5].cleaned == good
    assert QUERIES["op7_line_rules"](spark, empty_folder).collect() == []
