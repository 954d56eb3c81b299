"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of documents; n_chars follows changes of text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dedup
from gridloom.llm.queries import multi_ranks
from gridloom.llm.scratch import Scratch, small

#: A long text must be more like a language than three standard deviations of a chance resemblance; a text of HALF
#: characters half as much, and so on, as a resemblance grows with the length while chance does not.
CHANCE, HALF = 3 / language_id.DIM**0.5, 100


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no learned language is recognised: those without letters (so null, empty and blank texts),
    and those that resemble none more than by chance. Equal texts share their fate, and rows are judged one by one."""
    profiles = language_id.prototypes(docs.where(~language_id.held_out()).select("text", "lang"))
    found = language_id.identify(docs, profiles)
    odd = (F.col("lang_pred") == language_id.NONE) | (F.col("score") < F.lit(CHANCE) * F.length("text") / (F.length("text") + HALF))
    return found.where(~odd).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier line, by doc_id and number, matches; documents that lose a line and of which nothing but
    white space is left go. Null and empty texts have no lines to lose and stay."""
    done = line_dedup.dedup_lines(docs)
    changed = F.col("n_kept") < F.col("n_lines")
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.where(~changed | F.col("text").rlike(r"\S")).withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates, on shingles of five words. Texts without words, null
    doc_ids and repeated rows of a kept doc_id stay."""
    scratch = Scratch(spark, "near_stage")
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80, scratch=scratch)
    gone = scratch.keep(found.where("not kept").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts spans that are in benchmark items; documents of which they are more than half go. Null and empty texts stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = docs.withColumn("__before", F.length("text"))
    clean = decontaminate.decontaminate(marked, benchmark, window=10, most_cover=0.5)
    n_chars = F.when(F.length("text") != F.col("__before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs, a null text as an empty one: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), and digests of the ids and of their decoding."""
    ranks = multi_ranks()
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, spaced=True, decoded=True, lean=True).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_text),
    ("byte-level BPE", encode_tokens),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
