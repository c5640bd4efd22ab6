"""Column names of the accepted tables and the mapping to canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from recordlens.functions.text import present_text

# Header names of the accepted record tables, in order of preference.
HEADERS = {
    "work_item_id": ("BugID", "WorkItemId", "work_item_id"),
    "title": ("Title", "title"),
    "semantic_text": ("SemanticText", "semantic_text"),
    "tags": ("Tags", "tags"),
    "link": ("link", "Link"),
    "bug_url": ("BugUrl", "bug_url"),
    "changed_at": ("changed_at",),
    "seq": ("seq",),
}

REQUIRED_RECORD = ("work_item_id", "title", "semantic_text")

INDEX_COLUMNS = (
    "work_item_id",
    "title",
    "tags",
    "semantic_text",
    "link",
    "bug_url",
    "embedding",
    "fingerprint",
    "changed_at",
)

_DEFAULT_TYPE = {"changed_at": "timestamp", "seq": "bigint"}


def id_string(column: Column, dtype: T.DataType) -> Column:
    """Identifier as text; whole floating numbers lose their exponent form."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (F.floor(column) == column) & (F.abs(column) < F.lit(1e18))
        return (
            F.when(F.isnan(column), None)
            .when(whole, column.cast("bigint").cast("string"))
            .otherwise(column.cast("string"))
        )
    return column.cast("string")


def missing_columns(df: DataFrame, required) -> list[str]:
    """Sorted names of ``required`` canonical columns that no header of ``df`` provides."""
    present = set(df.columns)
    return sorted(c for c in required if not present.intersection(HEADERS.get(c, (c,))))


def require_columns(df: DataFrame, required=REQUIRED_RECORD) -> None:
    missing = missing_columns(df, required)
    if missing:
        wanted = [" or ".join(HEADERS.get(c, (c,))) for c in missing]
        raise ValueError(f"missing required column(s): {wanted}")


def canonical(df: DataFrame, required=REQUIRED_RECORD) -> DataFrame:
    """Select the known columns under canonical names; absent optional ones become NULL.

    Columns are taken by position, so a table with both ``link`` and ``Link`` is not ambiguous.
    """
    require_columns(df, required)
    headers = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(headers))])

    def pick(name: str) -> Column:
        found = [headers.index(h) for h in HEADERS[name] if h in headers]
        if not found:
            return F.lit(None).cast(_DEFAULT_TYPE.get(name, "string"))
        if name == "tags":
            return F.coalesce(*[present_text(F.col(f"_c{i}").cast("string")) for i in found])
        column = F.col(f"_c{found[0]}")
        if name == "work_item_id":
            return id_string(column, df.schema[found[0]].dataType)
        if name == "changed_at" and isinstance(df.schema[found[0]].dataType, T.NumericType):
            return F.timestamp_seconds(column)
        return column.cast(_DEFAULT_TYPE.get(name, "string"))

    return flat.select(*[pick(name).alias(name) for name in HEADERS])


def schema_report(df: DataFrame, required=REQUIRED_RECORD) -> DataFrame:
    """One row per required column: is it present, and how many rows fill it."""
    missing = set(missing_columns(df, required))
    counts = [
        (F.lit(0) if c in missing else F.count(F.col(_header(df, c)))).cast("bigint").alias(c)
        for c in required
    ]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(c not in missing).alias("present"),
                F.col(c).alias("filled_rows"),
            )
            for c in required
        ]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def _header(df: DataFrame, name: str) -> str:
    return next(h for h in HEADERS.get(name, (name,)) if h in df.columns)
