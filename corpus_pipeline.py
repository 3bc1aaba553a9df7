"""The corpus pipeline: documents through five stages, each one operator of ``jobscope.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobscope.llm.common import shared_dir, table
from jobscope.llm.language_id import accepted
from jobscope.llm.sampled_pieces import default_model, samples
from jobscope.llm.stages import without_benchmark, without_near_duplicates, without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a text without a letter, or a null one, goes."""
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id;
    rows without an id of their own come after, and are compared like others."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier one has; n_chars is the new text's.

    A document that loses all its words stays with an empty text.
    """
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece segmentations of each document."""
    return samples(docs, default_model())


STAGES = [
    ("language ID", language),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: No SQL: language profiles, the latent space and sampling can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{n}")
        docs = spark.read.parquet(f"{path}/{n}")
    return docs
