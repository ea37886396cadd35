"""A pipeline over `documents`: quality, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vicinal.llm import decontaminate, near, packing, pii, quality
from vicinal.llm.common import collected, removed, shared_folder, table


def roomy(stage: Callable) -> Callable:
    """`stage`, for whose Python workers the executors first give back what earlier stages left in their heaps."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@roomy
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labelled rows of `docs`."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select("row.*")


@roomy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.deduplicate(docs)


@roomy
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@roomy
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact(docs)


@roomy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences; workers keep less than usual, as those of earlier stages live on."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=200_000, encode=400_000)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

#: Fingerprints, classifiers and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row; each one's result is written as Parquet beside the checkpoints and read again.

    The last stage keeps its pieces in a checkpoint, so the results of the others are removed.  Null, empty
    and very long texts, repeated rows and empty tables are treated as each stage's operator says.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    removed(spark, folder)
    return packed
