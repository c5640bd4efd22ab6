"""One row per key. Aggregates combine on the map side, so a hot key never moves as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _pick(df: DataFrame, key: str, order: tuple[str, ...], choose) -> DataFrame:
    payload = [c for c in df.columns if c != key]
    # Equal order values are told apart by a hash of the content, so the choice does not depend on
    # the plan, and the payload is carried once.
    comparable = [c for c in payload if df.schema[c].dataType.typeName() != "map"]
    rank = F.struct(*order, F.xxhash64(*comparable) if comparable else F.lit(0))
    picked = df.groupBy(key).agg(choose(F.struct(*payload), rank).alias("_row"))
    fields = [F.col(f"_row.{c}").alias(c) if c != key else F.col(key) for c in df.columns]
    return picked.select(*fields)


def dedupe_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    return _pick(df, key, order, F.max_by)


def dedupe_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _pick(df, key, order, F.min_by)
