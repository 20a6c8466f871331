"""Corpus pipeline over ``documents``: five stages, each one operator of ``innkeep.llm``.

A stage takes (spark, docs, sf_dir) and returns a frame; its rows are written as
Parquet and read again as the next stage's ``docs``.  The first four return the
columns of ``documents``; the last one returns the packed pieces.

========================  ====================================================
quality_classifier        documents that the classifier rejects go
simhash_near_dedup        one document (the smallest id) of each group stays
benchmark_decontamination documents that hold a benchmark item go
pii                       personal spans become ``<KIND>``; n_chars follows
best_fit_packing          pieces of all kept documents with their place
========================  ====================================================

No SQL can express the classifier, so ``ORACLE_SQL`` is None and the pipeline
is tested against a plain Python version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.llm import decontamination, packing, pii, quality, simhash
from innkeep.llm.common import ensure_checkpoint_dir, table
from innkeep.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of this stage's input."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", mask_personal_data),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the stages' outputs lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    root = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
