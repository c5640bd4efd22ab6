"""Checks of vectors and of the pairing of records with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordlens.functions.vectors import UNIT_TOLERANCE, has_unit_norm


def is_normalized(
    df: DataFrame,
    column: str = "embedding",
    tolerance: float = UNIT_TOLERANCE,
) -> DataFrame:
    """One row: do all vectors have unit length; an empty table passes."""
    ok = F.bool_and(has_unit_norm(F.col(column), tolerance))
    return df.agg(F.coalesce(ok, F.lit(True)).alias("is_normalized"))


def dimension_range(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: smallest and greatest vector length, and whether they agree."""
    size = F.size(column)
    spread = df.agg(F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))
    same = F.coalesce(F.col("min_dim") == F.col("max_dim"), F.lit(True))
    return spread.withColumn("consistent", same)


def row_alignment(records: DataFrame, vectors: DataFrame, key: str = "work_item_id") -> DataFrame:
    """One row: row counts of both tables, and ids that one has without the other."""
    left = records.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    right = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("_v"))
    joined = left.join(right, key, "full")

    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    counts = joined.agg(
        total("_r").alias("record_rows"),
        total("_v").alias("vector_rows"),
        F.count_if(F.col("_v").isNull()).alias("records_without_vector"),
        F.count_if(F.col("_r").isNull()).alias("vectors_without_record"),
    )
    aligned = (
        (F.col("record_rows") == F.col("vector_rows"))
        & (F.col("records_without_vector") == 0)
        & (F.col("vectors_without_record") == 0)
    )
    return counts.withColumn("aligned", aligned)


def require_alignment(records: DataFrame, vectors: DataFrame, key: str = "work_item_id") -> None:
    """Raise unless every record has exactly one vector and the reverse."""
    figures = row_alignment(records, vectors, key).first()
    if not figures.aligned:
        raise ValueError(f"records and vectors are out of step: {figures.asDict()}")


def unaligned_ids(records: DataFrame, vectors: DataFrame, key: str = "work_item_id") -> DataFrame:
    """The offending ids, with the side that lacks them."""
    no_vector = records.join(vectors.select(key), key, "left_anti").select(key)
    no_record = vectors.join(records.select(key), key, "left_anti").select(key)
    return no_vector.withColumn("missing", F.lit("vector")).unionAll(
        no_record.withColumn("missing", F.lit("record"))
    )
