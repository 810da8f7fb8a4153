"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condspark.llm import decontaminate, langid, order_minhash, packing, queries, scratch, secret_scan

MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts are such) and those whose language isn't clear (score below 0.5).

    Repeated rows share their fate; without any labelled row no language is known and all are dropped.  Texts are read whole,
    however long; further columns stay, whatever their names.
    """
    return langid.accepted(docs, langid.train(docs, "lang"), MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one with the least doc_id, then place.

    Repeated rows are one class; rows without words, null texts included, are each their own.  A very long text is a block of
    its own; further columns stay, whatever their names.
    """
    return order_minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, an empty benchmark drops nothing.

    Repeated rows share their fate.  A very long text is a block of its own; further columns stay, whatever their names.
    """
    return decontaminate.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark, keeping each row; n_chars, if there, is counted anew (null for a null text)."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; a null text is empty and brings its end token alone."""
    return packing.pack(docs, queries.TOKENIZERS("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written as Parquet and read again, and what it read then goes, but for the input."""
    docs = given = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        written = scratch.table(kept, name)
        if docs is not given:
            scratch.drop(kept, docs)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
