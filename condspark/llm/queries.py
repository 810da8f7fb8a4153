"""The queries op1 to op13, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hilbert, katz, langid, merkle, oracles, order_minhash, packing, phrases, prefix_forest, quality, scratch, secret_scan, substring_dedup, token_output

TOKENIZERS = public_tokenizers.path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_katz_backoff(spark: SparkSession, sf_dir: str, order: int = 3) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = katz.katz_score(docs, train=~held_out(5), order=order)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = order_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", "is_first")


def op5_token_output(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    path = scratch.path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZERS(tokenizer), end_id=2)
    return token_output.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", F.octet_length(text).alias("n_bytes"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = hilbert.hilbert_shards(rows, ["lang", "source", "n_bytes"], 16, keep=["doc_id", "size", "text_crc32"], tie=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), size=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def held_out(fold: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold == 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, "lang", ~held_out(3))
    return langid.identify(docs, model).select("doc_id", held_out(3).alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZERS(tokenizer), end_id=0, capacity=2048)


def op11_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, contained=80, top=2000)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    forged = merkle.leaf_of([F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in fields])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, forged)
    out = merkle.manifest(table(spark, sf_dir, "documents"), fields, "lang", "doc_id", claimed)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name.startswith("op")}

ORACLE = oracles.ORACLE
