"""The numbered operators over the corpus tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, near_duplicates, prefix_trie, quality, quotation, repeated_bytes, sentence_spans, simhash, site_style, token_files, toxicity, vantage

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return token_files.read_documents(manifest).drop("found")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op5_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))  # a quarter of the labels stays unseen, to measure on
    return quality.quality(docs, model).drop("probability")


def op8_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.reply_ordered(table(spark, sf_dir, "conversations"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "text")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, distance=3)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("node", "end")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.hard_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = (op1_decontamination, op2_token_files, op3_toxicity, op4_near_duplicates, op5_site_style, op6_repeated_bytes, op7_quality, op8_quotation, op9_bpe, op10_sentence_spans, op11_simhash, op12_prefix_trie, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
