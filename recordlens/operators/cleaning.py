"""Cleaning of record tables and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordlens.functions.text import filled, is_blank, normalize_id, strip
from recordlens.schema import REQUIRED_RECORD, canonical


def clean_records(df: DataFrame, *, drop_null_title: bool = True) -> DataFrame:
    """Canonical rows with a normalised id and a non-blank body.

    Rows without id (and, for full tables, without title) go; a blank body falls back to the
    title, and rows that still have none go. Change feeds keep NULL titles as empty text.
    """
    rows = canonical(df, REQUIRED_RECORD)
    rows = rows.na.drop(subset=["work_item_id", "title"] if drop_null_title else ["work_item_id"])
    no_body = is_blank(F.col("semantic_text"))
    # Filtering on the raw columns keeps the pushed-down condition short.
    rows = rows.where(~is_blank(F.col("work_item_id")) & ~(no_body & is_blank(F.col("title"))))
    body = F.when(no_body, F.col("title")).otherwise(F.col("semantic_text"))
    return rows.withColumns(
        {
            "work_item_id": normalize_id(F.col("work_item_id")),
            "title": filled(F.col("title")),
            "semantic_text": strip(body),
        }
    )
