"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ann, byte_bpe, decontaminate, language_id, line_dedup, near_dedup, oracle, pii, quality_lm, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def multi_ranks() -> bytes:
    return Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.roundtrip_digests(_table(spark, sf_dir, "documents"), multi_ranks(), public_tokenizers.PATTERN, spaced=True)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_kept", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_lm.quality(_table(spark, sf_dir, "documents"), trusted)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.prototypes(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), profiles).drop("text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), multi_ranks(), public_tokenizers.PATTERN, spaced=True)


#: The registered query shows the operator; whoever uses it on real text sets a secret key there.
DEMONSTRATION_KEY = "pseudonym key"


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.gridloom.pseudonym.key", DEMONSTRATION_KEY)
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, labels, ["low_quality", "toxic"]).drop("text")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.window_digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_byte_bpe, op2_minhash_near_dedup, op3_line_dedup, op4_quality_classifier, op5_language_id, op6_token_counts,
        op7_pii_pseudonyms, op8_toxicity, op9_nearest_neighbours, op10_decontaminate,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others are held against plain versions in tests: SQL has no BPE, trained model or index."""
    return {"op2_minhash_near_dedup": oracle.NEAR, "op3_line_dedup": oracle.LINES, "op10_decontaminate": oracle.WINDOWS}
