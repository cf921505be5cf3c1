"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm.align import align
from crashlens.llm.chat import render_chats
from crashlens.llm.classifier import classify
from crashlens.llm.decontaminate import contaminated
from crashlens.llm.line_dedup import dedup_lines
from crashlens.llm.manifest import fold, manifest, path_digest, tampered
from crashlens.llm.minhash import near_duplicates
from crashlens.llm.mixing import mix
from crashlens.llm.oracle import ORACLE
from crashlens.llm.quality import judge
from crashlens.llm.sharding import byte_shards
from crashlens.llm.substrings import remove_repeats
from crashlens.llm.tokens import token_counts
from crashlens.llm.urls import filter_urls


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(_read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents", "doc_id", "text")).select("row.doc_id", "k.*")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages", "page_id", "url")).select("row.page_id", "u.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_read(spark, sf_dir, "documents", "doc_id", "text", "lang")).select("row.doc_id", "q.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents", "doc_id", "text"),
                        _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("row.doc_id", "m.size", "m.source_size", "m.target",
                      (F.col("m.size") * F.col("m.copies")).alias("taken"), "m.copies")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("row.doc_id", "q.*")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest(_read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"), tamper=tampered())
    folded = out.withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_line_dedup, op2_chat_format, op3_token_counts, op4_sharding, op5_url_filter, op6_quality_rules,
            op7_decontamination, op8_minhash_dedup, op9_substring_dedup, op10_mixing, op11_quality_classifier,
            op12_tokenizer_alignment, op13_merkle_manifest)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
