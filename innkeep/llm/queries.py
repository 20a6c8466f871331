"""Registered queries of the operators in this package and their oracle SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.llm import alignment, chat, decontamination, embeddings, oracle, packing, paragraphs, pii, quality, simhash, structure, suffix, topk, toxicity
from innkeep.llm.common import table


def tokenizer_path() -> str:
    """The public tokenizer file named by the contract (never copied)."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` covered by repeated 200-byte strings, and what stays."""
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all ``embeddings``."""
    return embeddings.components(table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a whole text of ``documents``: its best and its other occurrences."""
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_words=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return pii.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` (one row per turn) and conversation -7 (a JSON record
    of the messages layout), formatted and read back."""
    words = "</s>[INST] ok [/INST]"                                   # fixed value of the contract
    record = json.dumps({"messages": [{"role": r, "content": words} for r in ("user", "assistant")]})
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(record).alias("record"))
    turns = chat.turns_of_table(table(spark, sf_dir, "conversations")).unionByName(
        chat.turns_of_records(extra, "conv_id", "record"))
    return chat.report(chat.format_turns(turns))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.components(table(spark, sf_dir, "documents"))


def op9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and passages of ``documents`` that repeat, and their removal."""
    return paragraphs.report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after the damage of the contract."""
    conversations = table(spark, sf_dir, "conversations")
    return structure.report(conversations, structure.damage(conversations))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of ``documents`` by two tokenizers: groups, links and their corpus counts."""
    import public_tokenizers
    return alignment.count_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best scores of every hundredth vector of ``embeddings`` against all others."""
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.drop("query_row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_embeddings": op2_embeddings,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_paragraphs": op9_paragraphs,
    "op10_packing": op10_packing,
    "op11_structure": op11_structure,
    "op12_alignment": op12_alignment,
    "op13_topk": op13_topk,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLE)
