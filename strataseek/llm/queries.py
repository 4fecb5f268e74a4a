"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alerts, html, media, minhash, mixing, ngram, packing, pieces, pii, resampling, substrings, toxicity, vectors
from .common import table


def piece_model(name: str = "piece_bpe_32k.model") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(table(spark, sf_dir, "pages"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), with_text=False).withColumnRenamed("kept", "kept_sha256")


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table, rendered as short recordings: those with ids divisible by 20 against all."""
    return media.aligned(media.fingerprints(media.rendered(table(spark, sf_dir, "embeddings")), "rec_id", "media"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), piece_model(), digests=True)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.lm_scores(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, towards the texts of benchmark."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_missing_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.missing_follow_ups(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.packed(table(spark, sf_dir, "documents"), piece_model("byte_bpe_50k.json"))
    return pieces_.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_html_extraction, op3_embedding_near_dedup, op4_personal_data, op5_mix_sources, op6_toxicity, op7_suffix_dedup, op8_chroma_fingerprints, op9_sentencepiece, op10_lm_scoring, op11_importance_resampling, op12_missing_follow_up, op13_packing)}
ORACLES = {"op5_mix_sources": mixing.ORACLE, "op11_importance_resampling": resampling.ORACLE, "op12_missing_follow_up": alerts.ORACLE}
