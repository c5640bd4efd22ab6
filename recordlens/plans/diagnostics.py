"""Integrity report and statistics of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordlens.functions.display import short_timestamp
from recordlens.functions.vectors import has_unit_norm
from recordlens.plans.search import search
from recordlens.schema import missing_columns

# Query of the sample search and names of the checks.
SAMPLE_QUERY = "test error"
SCHEMA_CHECK = "Metadata loaded + schema valid"
VECTOR_CHECK = "Embeddings loaded"
ALIGNMENT_CHECK = "Row alignment"
UNIT_CHECK = "Embeddings have unit length"
STATE_CHECK = "Refresh state readable"
SEARCH_CHECK = "Sample semantic search"


def diagnostics(
    records: DataFrame,
    vectors: DataFrame,
    state: DataFrame,
    index: DataFrame,
    *,
    embedder=None,
    vector: Column | None = None,
) -> DataFrame:
    """Checks as rows ``(name, ok, message, overall_ok)``.

    Each input is scanned once: its figures enter the single report row as a scalar subquery.
    """
    missing = missing_columns(records, ("work_item_id", "title", "bug_url"))
    figures = records.sparkSession.range(1, numPartitions=1).select(
        records.agg(F.count(F.lit(1))).scalar().alias("records"),
        vectors.agg(
            F.struct(
                F.count(F.lit(1)).alias("n"),
                F.max(F.size("embedding")).alias("dim"),
                F.coalesce(F.min(F.size("embedding")) == F.max(F.size("embedding")), F.lit(True))
                .alias("one_dim"),
                F.coalesce(F.bool_and(has_unit_norm(F.col("embedding"))), F.lit(True))
                .alias("unit"),
            )
        )
        .scalar()
        .alias("v"),
        state.agg(
            F.max(F.struct("last_refresh_time", "refreshed_at"))
        )
        .scalar()
        .alias("s"),
        search(index, SAMPLE_QUERY, 1, embedder=embedder, vector=vector)
        .agg(F.max("work_item_id"))
        .scalar()
        .alias("top"),
    )
    n, dim = F.col("v.n").cast("string"), F.col("v.dim").cast("string")
    loaded = F.concat(F.lit("records: "), F.col("records").cast("string"))
    if missing:
        loaded = F.concat(loaded, F.lit(f"; absent: {' '.join(missing)}"))
    checks = [
        (SCHEMA_CHECK, F.lit(not missing), loaded),
        (
            VECTOR_CHECK,
            F.col("v.one_dim"),
            F.concat(n, F.lit(" vectors of "), F.coalesce(dim, F.lit("0")), F.lit(" numbers")),
        ),
        (
            ALIGNMENT_CHECK,
            F.col("v.n") == F.col("records"),
            F.concat(
                n, F.lit(" vectors for "), F.col("records").cast("string"), F.lit(" records"),
            ),
        ),
        (
            UNIT_CHECK,
            F.col("v.unit"),
            F.when(F.col("v.unit"), "all").otherwise("some are not"),
        ),
        (
            STATE_CHECK,
            F.col("s.refreshed_at").isNotNull(),
            F.coalesce(
                F.concat(F.lit("refreshed at "), F.col("s.last_refresh_time")),
                F.lit("never refreshed"),
            ),
        ),
        (
            SEARCH_CHECK,
            F.col("top").isNotNull(),
            F.coalesce(
                F.concat(
                    F.lit("best match: "), F.col("top").cast("string")
                ),
                F.lit("no match"),
            ),
        ),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.coalesce(ok, F.lit(False)).alias("ok"),
                message.alias("message"),
            )
            for name, ok, message in checks
        ]
    )
    return overall(figures.select(F.explode(rows).alias("c")).select("c.*"))


def overall(report: DataFrame) -> DataFrame:
    """Add whether all checks of the (short) report passed."""
    everything = Window.partitionBy(F.lit(1))
    return report.withColumn("overall_ok", F.bool_and("ok").over(everything))


def index_stats(index: DataFrame, refreshed: DataFrame | None = None) -> DataFrame:
    """One row: indexed records, time of the newest one, counts of the last refresh."""
    totals = index.agg(
        F.count(F.lit(1)).alias("total_indexed"),
        F.coalesce(short_timestamp(F.max("changed_at")), F.lit("—")).alias("last_indexed"),
    )
    if refreshed is None:
        return totals
    last = refreshed.select(F.struct("added", "updated", "skipped")).scalar()
    return totals.withColumn("_r", last).select(
        "total_indexed", "last_indexed", "_r.added", "_r.updated", "_r.skipped"
    )
