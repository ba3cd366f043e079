"""Quality rules, lines first: remove failing lines, then reject documents that lose too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.llm.native import GAP, WORD, let, total, upto, words_of

SYMBOL = r"[#*$%&|<>]"
BAR = r"[|»›·•]"
MARK = r"[.!?:;…][\"'”’)\]]*(\s|$)"
SHOUT = r"!!"
BOILERPLATE = (
    r"(?i)(cookie|javascript|lorem ipsum|all rights reserved|terms of (use|service)|privacy policy|sign (in|up)\b|"
    r"log ?in\b|click here|read more|subscribe|skip to content|back to top)"
)
LONG_LINE = 10
KEEP_PERCENT = 70
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def word_chars(text: Column) -> Column:
    """Code points of a text that belong to words."""
    return F.char_length(F.regexp_replace(text, GAP, "")).cast("long")


def line_passes(line: Column) -> Column:
    """Whether a line stays.

    Punctuation: not many symbols or shouts among few words, and a long line has a mark that ends a clause. Navigation:
    no bars or bullets between every few words. Boilerplate: none of the set phrases. Repetition: a long line has more
    than a third of different words. A line without a word fails.
    """
    def judged(words: Column) -> Column:
        n = F.size(words)
        return (
            (n > 0)
            & ((F.regexp_count(line, F.lit(SYMBOL)) < 2) | (F.regexp_count(line, F.lit(SYMBOL)) * 4 < n))
            & ((F.regexp_count(line, F.lit(SHOUT)) < 2) | (F.regexp_count(line, F.lit(SHOUT)) * 4 < n))
            & (F.regexp_count(line, F.lit(BAR)) * 4 < n)
            & ((n < LONG_LINE) | (F.regexp_count(line, F.lit(MARK)) > 0))
            & ((n < LONG_LINE) | (F.size(F.array_distinct(words)) * 3 > n))
            & (F.regexp_count(line, F.lit(BOILERPLATE)) == 0)
        )

    return let(words_of(line), judged)


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a run of three words found twice or more.

    Runs are sorted by hash and place, so that equal ones are neighbours; the places of repeated ones, sorted, then cover
    three words each less what they share with the one before.
    """
    def of(words: Column) -> Column:
        runs = F.transform(
            upto(F.size(words) - 2),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
        return let(F.sort_array(runs), places)

    def places(runs: Column) -> Column:
        again = F.filter(
            runs,
            lambda r, k: (F.get(runs, k - 1)["h"] == r["h"]) | (F.get(runs, k + 1)["h"] == r["h"]),
        )
        return let(F.sort_array(F.transform(again, lambda r: r["i"])), covered)

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get(at, k - 1), F.lit(3))).cast("long"))
        return total(own)

    return let(words, of)


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``cleaned`` (the lines that stay), ``kept`` and the counts behind the verdict.

    Counts: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` (lines with a word that equal an earlier one) and
    ``n_repeat_words``. ``base_failed``: fewer than 50 words, or more than half of them repeated. ``kept`` is false for
    those, and for texts whose remaining lines hold under 70 percent of the characters in words. Of equal lines the first
    stays. A null text is empty, has counts of 0 and is rejected. Other columns and repeated rows stay; columns that have
    the names of new ones are replaced. Expressions of Spark only; no row moves.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(own, "\n")
    with_word = F.filter(lines, lambda x: F.regexp_like(x, F.lit(WORD)))
    facts = let(
        own,
        lambda t: F.struct(
            let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again"))).alias("w"),
            word_chars(t).alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        ),
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", "base_failed", "kept"]
    out = df.drop(*names).withColumn("_facts", facts)
    out = out.withColumn(
        "_lines",
        let(with_word, lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"),
            F.array_distinct(F.filter(x, line_passes)).alias("stay"),
        )),
    )
    out = out.withColumn("_stay", total(F.transform("_lines.stay", word_chars)))
    failed = (F.col("_facts.w.n") < FEWEST_WORDS) | (100 * F.col("_facts.w.again") > MOST_REPEATED_PERCENT * F.col("_facts.w.n"))
    return (
        out.withColumn("n_words", F.col("_facts.w.n"))
        .withColumn("word_chars", F.col("_facts.word_chars"))
        .withColumn("n_symbols", F.col("_facts.n_symbols"))
        .withColumn("n_dup_lines", F.col("_lines.again"))
        .withColumn("n_repeat_words", F.col("_facts.w.again"))
        .withColumn("cleaned", F.array_join("_lines.stay", "\n"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * F.col("_stay") >= KEEP_PERCENT * F.col("_facts.word_chars")))
        .drop("_facts", "_lines", "_stay")
    )
