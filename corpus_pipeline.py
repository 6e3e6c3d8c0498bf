"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Each stage is a function of (spark, docs, sf_dir).  All but the last return the columns of
``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontamination, near_duplicates, sentence_spans, toxicity
from rasterloom.llm.queries import BYTE_BPE, table
from rasterloom.llm.scratch import new_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled rows of the corpus.

    Each row is scored by its own text: rows without an id or text, repeated rows and repeated ids are judged like any other.
    An empty table stays empty.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, 0.8): that of least id.

    Rows of one id are one document: all of them stay or go.  Rows without an id, which no other row can name as its
    duplicate, stay; so do rows without words, which are linked with nothing.  An empty table stays empty.
    """
    found = near_duplicates.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated spans; documents of which nothing stays go.

    Rows are told apart though they share an id or have none; of rows with equal spans, ties included, one keeps them.
    Null and empty texts stay as they are.  An empty table stays empty.
    """
    cut = sentence_spans.substring_dedup(docs)
    kept = cut.where("n_removed = 0 or n_removed < n_sentences").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Each row is judged by its own text, whatever other rows share its id, or if it has none; equal rows stay or go
    together.  Null and empty texts have no words and stay.  An empty table, or benchmark, loses nothing.
    """
    key = F.xxhash64(docs["doc_id"].isNull(), docs["doc_id"], docs["text"].isNull(), docs["text"])  # of 64 bits: a key for each distinct row
    found = decontamination.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("hit")).distinct()
    return docs.join(hit, key == hit["hit"], "left_anti").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count, hashes of its ids and of their decoded text.

    A row for each row, repeated ones and those without an id included; a null text counts as empty.
    """
    return bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the trained classifier of the first stage; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
