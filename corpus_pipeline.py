"""Training-data pipeline over the documents table.

Language identification, one document of each group of near-duplicates, removal
of repeated passages, benchmark decontamination, and packing. Each stage takes
(spark, docs, sf_dir); its result is written as Parquet and read as the next one's
documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upshot.llm import decontaminate, jaccard_join, langid, packing, substring_dedup
from upshot.llm.common import documents, materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go. Texts and languages
    stay as they are."""
    model = langid.train(docs.where(~langid.held_out()))
    return langid.classify(docs, model).where("lang_pred <> 'und'").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id."""
    return jaccard_join.keep_one(docs).select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has are removed, ``n_chars``
    follows; a document that loses all its words goes."""
    out = substring_dedup.dedup_substrings(docs).where("n_removed = 0 or n_removed < n_words")
    kind = docs.schema["n_chars"].dataType
    changed = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast(kind)).otherwise(F.col("row.n_chars"))}
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), verbatim=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", remove_benchmark),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None  # a trained model and a tokenizer are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return docs
