"""Index build, joins of records with given vectors, vector upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordlens.functions.text import embedding_text, fingerprint
from recordlens.functions.vectors import has_unit_norm, l2_normalize
from recordlens.operators.cleaning import clean_records
from recordlens.operators.quality import dimension_range, require_alignment
from recordlens.schema import INDEX_COLUMNS


def with_fingerprint(cleaned: DataFrame, *, include_tags: bool = False) -> DataFrame:
    """Add the content hash; ``include_tags`` makes a change of tags count as a change."""
    body = F.col("semantic_text")
    if include_tags:
        body = F.concat(body, F.lit("|"), F.coalesce(F.col("tags"), F.lit("")))
    value = fingerprint(F.col("work_item_id"), F.col("title"), body)
    return cleaned.withColumn("fingerprint", value)


def record_text():
    return embedding_text(F.col("title"), F.col("tags"), F.col("semantic_text"))


def build_index(records: DataFrame, embedder, *, include_tags: bool = False) -> DataFrame:
    """Clean, compose the text, embed, fingerprint: one row per record, no shuffle."""
    cleaned = with_fingerprint(clean_records(records), include_tags=include_tags)
    embedded = cleaned.withColumn("embedding", embedder.column(record_text()))
    return embedded.select(*INDEX_COLUMNS)


def make_index(records: DataFrame, vectors: DataFrame, *, strict: bool = True) -> DataFrame:
    """Index from cleaned records and given ``vectors(work_item_id, embedding)``.

    An inner join on the id, once at ingest; afterwards record and vector share a row. A record without
    vector, or the reverse, is an error; ``strict=False`` leaves such rows out, and ``unaligned_ids`` lists them.
    """
    if strict:
        require_alignment(clean_records(records), vectors)
    cleaned = with_fingerprint(clean_records(records))
    paired = cleaned.join(vectors.select("work_item_id", "embedding"), "work_item_id")
    return paired.select(*INDEX_COLUMNS)


def check_dimension(index: DataFrame, dim: int | None, known: tuple[int | None, int | None] | None = None) -> None:
    """Raise when the stored vectors have another length than the embedder gives.

    ``known`` are the shortest and longest length if they were counted before; else all vectors are scanned.
    """
    if dim is None:
        return
    if known is None:
        found = dimension_range(index.where(F.col("embedding").isNotNull())).first()
        known = (found.min_dim, found.max_dim)
    if known[0] is not None and known != (dim, dim):
        raise ValueError(f"embedding dimension mismatch: index {known[0]} to {known[1]}, new {dim}")


def renormalize_index(index: DataFrame) -> DataFrame:
    """Bring vectors that are not of unit length to it; others keep their bits."""
    vector = F.col("embedding")
    fixed = F.when(has_unit_norm(vector), vector).otherwise(l2_normalize(vector))
    return index.withColumn("embedding", fixed)
