"""Cleaning, thinning, mixing and encoding a corpus: stages that each read what the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a frame. All but the last return the columns of ``docs``; the last
returns the mixed documents with their token ids. Decisions are made on a stage's own input: the quality model is
trained on the labels of ``sf_dir`` and the texts it is given, and counts, joins and mixing targets cover just those rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm import bpe, mixing, ngram_join, quality_model, repeats
from mlwatch.llm.labelled import remainder
from mlwatch.operators.frames import shared_dir

KEEP_SCORE = 0.3
WORD_BPE = "word_bpe_49k.json"


def apart(docs: DataFrame, made: Sequence[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` makes of the documents, with their columns; those that have a name of one that it makes have another meanwhile."""
    names = {m.lower() for m in made}
    other = {c: f"column {i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    back = [F.col(f"`{other[c]}`").alias(c) if c in other else F.col(f"`{c}`") for c in docs.columns]
    return stage(docs.withColumnsRenamed(other)).select(*back)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: those that score at least KEEP_SCORE.

    Null and empty texts are scored as empty ones; repeated rows share their fate; an empty table, or one without labels, keeps all it
    has; other columns stay as they are, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.train(docs, labels, remainder("doc_id", 5) != 0)
    return apart(docs, ["score"], lambda d: quality_model.score(d, model, into="score").where(F.col("score") >= KEEP_SCORE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect, the one with the smallest id; and those without words.

    Of repeated rows one stays; rows without an id stand behind all others; an empty table stays empty; other columns stay as they are.
    """
    return ngram_join.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings cover; what is left of a cut character goes too, and n_chars follows.

    All rows stay. Null, empty and short texts are not cut; repeated rows lose their whole texts; an empty table stays empty; other
    columns stay as they are.
    """

    def stage(d: DataFrame) -> DataFrame:
        # workers of the stages before still hold memory
        cut = repeats.remove_repeats(d, anchor_parts=int(spark.conf.get("spark.sql.shuffle.partitions")), sift=False)
        cut = cut.withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("rest")))
        length = F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.char_length("text"))
        return cut.withColumn("n_chars", length.cast(d.schema["n_chars"].dataType))

    return apart(docs, ["n_bytes", "spans", "kept", "rest"], stage)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its sources takes it.

    The null source is a source; null texts have size 0; rows of one id share their fate; an empty table stays empty; other columns
    stay as they are.
    """

    def stage(d: DataFrame) -> DataFrame:
        sized = mixing.word_count(d)
        return mixing.emit(mixing.copies(sized, mixing.cyclic_weights(mixing.source_sizes(sized))))

    return apart(docs, ["size", "source_size", "target", "copies"], stage)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as token ids, and the text that these stand for.

    A null text is empty and has no tokens; repeated rows are encoded alike; an empty table gives no rows; other columns are not read.
    """
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path(WORD_BPE))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("source mixing", mix),
    ("BPE", encode),
]
# A trained classifier and repeated byte strings are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result is written to the folder that the cluster shares and read again, so that a
    lost executor costs tasks of one stage and none is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
