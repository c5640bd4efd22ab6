"""Ordering of mixed display values, and places in a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordlens.functions.display import sort_class, sort_number, sort_text
from recordlens.operators.joins import small_side
from recordlens.session import materialize


def display_keys(df: DataFrame, column: str) -> DataFrame:
    """Add the sort keys ``sort_number``, ``sort_class`` and ``sort_text``."""
    value = F.col(column)
    numbered = df.withColumn("sort_number", sort_number(value))
    classed = numbered.withColumn("sort_class", sort_class(value, F.col("sort_number")))
    return classed.withColumn("sort_text", sort_text(value, F.col("sort_class")))


def display_sort(df: DataFrame, column: str, desc: bool = False) -> DataFrame:
    """Numbers and percentages, then text without case, then blanks; ``desc`` flips it all.

    A range-partitioned global sort. The keys are columns, as a sort would evaluate expressions
    anew in every comparison; they stay in the result. Ties fall back to the raw value and then
    to a hash of the row, so that rows of one frequent value still spread over many tasks.
    """
    keyed = display_keys(df, column).withColumn("_tie", F.xxhash64(*df.columns))
    keys = [F.col(c) for c in ("sort_class", "sort_number", "sort_text", column, "_tie")]
    order = [k.desc_nulls_last() if desc else k.asc_nulls_first() for k in keys]
    return keyed.orderBy(*order).drop("_tie")


def with_positions(
    stored: DataFrame, order: list[Column], name: str = "position", group: str | None = None, folder: str | None = None
) -> DataFrame:
    """``stored`` rows with their place, from 0, in the sort by ``order``, within each value of ``group`` if one is named.

    Rows are dealt into ranges of the sort keys, sorted in their tasks and written below ``folder`` with their place in the
    range; the counts per range (as many rows as ranges, plus one per group) give the offsets. So no task sees the whole
    table or a whole group. Rows that are equal in ``order`` lie in one range: end it with a column that tells copies apart.
    ``stored`` is scanned twice, as ranges are sampled first. NULL is a group of its own, before all others.
    """
    keys = ([F.col(group).asc_nulls_first()] if group else []) + list(order)
    inner = F.struct(*[F.col(c) for c in stored.columns]).alias("row")
    by = F.col(f"row.{group}") if group else F.lit(None).cast("string")
    sorted_rows = stored.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = sorted_rows.select(inner, F.spark_partition_id().alias("part"), place.alias("place"))
    written = materialize(numbered, f"positions-{name}", folder)
    counts = written.groupBy("part", by.alias("by")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("part").alias("o_part"), F.col("by").alias("o_by"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    same = (F.col("part") == F.col("o_part")) & by.eqNullSafe(F.col("o_by"))
    joined = written.join(small_side(materialize(offsets, f"offsets-{name}", folder)), same)
    return joined.select("row.*", (F.col("place") + F.col("shift")).alias(name))


def last_before(stored: DataFrame, group: list[str], order: str, value: str, folder: str | None = None) -> DataFrame:
    """``stored`` with ``value`` replaced by its last non-NULL value in an earlier row of the group, by ``order``.

    An as-of join of a table with itself, without a task that holds a group: rows are dealt into ranges of (group, order)
    and written; each range carries values forward on its own, and starts from the last value of the ranges before it, of
    which a group has one row per range. Rows equal in ``order`` see the same earlier rows.
    """
    keys = [F.col(c) for c in (*group, order)]
    written = materialize(
        stored.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), f"ranges-{value}", folder
    )
    held = written.where(F.col(value).isNotNull()).groupBy("_part", *group).agg(F.max_by(value, order).alias("_held"))
    # Ranges without a value of the group carry the one before them, so every range of a group has a row.
    parts = written.select("_part", *group).distinct().join(held, ["_part", *group], "left")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", *group, F.last("_held", ignorenulls=True).over(before).alias("_held"))
    within = Window.partitionBy("_part", *group).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    local = written.withColumn("_local", F.last(value, ignorenulls=True).over(within))
    joined = local.join(carried, ["_part", *group], "left")
    found = F.coalesce("_local", "_held")
    return joined.withColumn(value, found).drop("_part", "_local", "_held").select(*stored.columns)
