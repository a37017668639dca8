"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voc.llm import (
    bpe_tree, kneser_ney, line_templates, mixing, multiset_hash, page_text, periodic_runs, personal_data, phrases, quality, simhash,
    token_files, toxicity,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(_table(spark, sf_dir, "documents"), BYTE_BPE, end=0))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality")


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edits(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_templates.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digests(_table(spark, sf_dir, "documents"), MULTI_RANKS)


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_personal_data, op2_token_files, op3_kneser_ney, op4_mixing, op5_quality, op6_multiset_hash, op7_line_dedup, op8_bpe,
        op9_page_text, op10_simhash, op11_toxicity, op12_phrases, op13_periodic_runs,
    )
}

STATEMENTS = {"op12_phrases": phrases.PHRASES_SQL}
