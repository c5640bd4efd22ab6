"""The corpus pipeline: every stage works on all that the stage before it kept.

A stage takes (spark, docs, sf_dir), where docs is a table scan. ``run`` writes each stage's result to the shared folder and
reads it again, as a driver of the single stages would. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlens.llm import best_fit_packing, ngram_join, secret_scans, suffix_dedup, toxicity
from recordlens.llm.common import bounded_batches
from recordlens.session import materialize, scratch_path

# A passage of over 50 words has more bytes than this in the languages of the corpus, at 4 letters a word and a space.
PASSAGE_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for toxicity is below one half."""
    bounded_batches(spark, 512, 2 << 20)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train_on(docs, labels))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bounded_batches(spark, 512, 2 << 20)
    return ngram_join.drop_duplicates(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that occur more than once."""
    bounded_batches(spark, 512, 2 << 20)
    return suffix_dedup.remove_repeats(docs, PASSAGE_BYTES)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced by a mark."""
    return secret_scans.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return best_fit_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_near_copies),
    ("suffix_dedup", remove_repeated_passages),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None  # a trained classifier and MinHash cannot be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name, folder)
    return docs
