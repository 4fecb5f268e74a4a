"""The corpus pipeline: toxic documents go, near-duplicates fold to one, personal data is masked, sources are mixed to their
target weights, and what remains is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet to the shared
folder and reads it for the next, then drops the one before. All stages but the last return the columns of documents.

An empty table passes through every stage; a null text is never toxic, near another, masked or chosen before others, and has
no pieces; rows with a null doc_id stay and repeated rows are judged each, but near duplicates fold by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataseek.llm import minhash, mixing, pieces, pii, toxicity
from strataseek.llm.common import dropped, saved, table
from strataseek.llm.queries import piece_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the smallest doc_id of each group stays."""
    return minhash.kept_documents(docs, width=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded, checked, a row for each row of the mix."""
    return pieces.encoded(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
