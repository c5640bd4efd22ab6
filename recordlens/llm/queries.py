"""The queries of the numbered operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from recordlens.llm import (
    best_fit_packing, byte_bpe, decontamination, embedding_dedup, language_id, merkle_manifest, ngram_join, oracle,
    oracle_audits, quality_rules, secret_scans, source_divergence, suffix_dedup, toxicity, url_filters,
)
from recordlens.llm.common import UID, table

URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


VOCABULARY_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_url_filters(spark, folder) -> DataFrame:
    return url_filters.filter_urls(table(spark, folder, "pages"), URL_RULES)


def op2_byte_bpe(spark, folder) -> DataFrame:
    import public_tokenizers  # only this query needs the vocabulary files

    path = public_tokenizers.path(VOCABULARY_FILE)
    vocabulary = byte_bpe.Vocabulary.read(path, public_tokenizers.PATTERN)
    return byte_bpe.digests(table(spark, folder, "documents"), vocabulary)


def op3_embedding_dedup(spark, folder) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op4_suffix_dedup(spark, folder) -> DataFrame:
    return suffix_dedup.report(table(spark, folder, "documents"))


def op5_secret_scans(spark, folder) -> DataFrame:
    return secret_scans.report(secret_scans.scan(table(spark, folder, "documents")))


def op6_best_fit_packing(spark, folder) -> DataFrame:
    return best_fit_packing.pack(table(spark, folder, "documents"))


def op7_toxicity(spark, folder) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.predict(docs, toxicity.train_on(docs, labels))


def op8_quality_rules(spark, folder) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


def op9_language_id(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.predict(docs, language_id.train_on(docs))


def op10_ngram_join(spark, folder) -> DataFrame:
    return ngram_join.classes(table(spark, folder, "documents")).drop(UID)


def op11_decontamination(spark, folder) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_source_divergence(spark, folder) -> DataFrame:
    return source_divergence.audit(table(spark, folder, "documents"))


def op13_merkle_manifest(spark, folder) -> DataFrame:
    return merkle_manifest.manifest(table(spark, folder, "documents"), merkle_manifest.lowered_where_sampled())


def named() -> dict[str, Callable]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def sql() -> dict[str, str]:
    return oracle.sql(URL_RULES) | oracle_audits.sql()
