"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import bpe, decontam, langid, pii, similar
from timberline.llm.queries import tokenizer
from timberline.llm.tables import table
from timberline.session import remove, scratch_dir


#: Bytes of a batch that goes to a Python worker and back, about: what executors hold outside their heap grows with it.
BATCH = "4m"


def _batches(spark: SparkSession) -> None:
    """Whole texts go through Python in batches of ``BATCH``, also where a few are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language explains go. The model is fitted on the stage's labelled input; without labels all with a letter stay."""
    _batches(spark)
    return langid.filter_language(docs, langid.fit(docs, ranges=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that pairs connect which share 0.8 of their five-word shingles."""
    _batches(spark)
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim passage of a benchmark item go."""
    _batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; ``n_chars`` follows the text."""
    _batches(spark)
    return pii.redact_pii(docs, length_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the token ids of the whole text."""
    _batches(spark)
    return bpe.encode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
