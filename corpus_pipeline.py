"""Corpus pipeline: documents in, packed training sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's ``docs``. Stages that change texts
bring ``n_chars`` up to date and drop documents that they leave without a word. Rows go to Python in
batches of bounded bytes: ten thousand whole texts at once cost an executor hundreds of MB, in its
JVM and in every worker that it keeps from stage to stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import base, chunks, jaccard, lines, ordinal, packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH = "2m"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """The stage with batches of at most about ``BATCH``, also where its result is written later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


def _rewritten(docs: DataFrame, removed: str) -> DataFrame:
    """Documents after a stage that cut texts by ``removed`` items."""
    left = docs.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


@_in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    model = ordinal.fit_labelled(docs, base.table(spark, sf_dir, "labels"))
    return ordinal.score(docs, model).filter("NOT toxic").select(*COLUMNS)


@_in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of like lines."""
    return _rewritten(lines.deduplicate(docs.select(*COLUMNS)), "removed_lines")


@_in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join."""
    return jaccard.one_of_each_group(docs.select(*COLUMNS))


@_in_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each repeated passage."""
    return _rewritten(chunks.deduplicate(docs.select(*COLUMNS)), "removed_words")


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 tokens holding every token of the documents that are left."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: The learned, hashed and greedy stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
