"""Joins of a large table with the keys of a small one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 32 << 20


def small_side(keys: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``keys`` marked for broadcast when their measured size is within ``limit``.

    Beyond it they come back unmarked and Spark shuffles both sides. Measuring runs a job over the
    key columns, so ``keys`` should be stored data. Spark's own estimate is no substitute: it
    goes by file size, which counts the texts and vectors next to the keys.
    """
    row = F.lit(16)
    for name in keys.columns:
        row = row + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    size = keys.agg(F.sum(row.cast("bigint"))).first()[0] or 0
    return F.broadcast(keys) if size <= limit else keys


def heavy_keys(rows: DataFrame, keys: list[str], share: int) -> DataFrame:
    """``keys`` that hold over ``1 / share`` of all rows, with ``_pieces``: in how many pieces to cut their rows.

    Counted with map-side combining. There are fewer than ``share`` such keys, whatever the input.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    pieces = F.ceil(F.col("_n") * share / F.col("_all")).cast("int")
    found = counted.join(F.broadcast(total)).where(F.col("_n") * share > F.col("_all"))
    return found.select(*keys, pieces.alias("_pieces"))


def spread_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner",
    *, limit: int = BROADCAST_BYTES, share: int | None = None,
) -> DataFrame:
    """Join stored ``rows`` with stored ``lookup`` on ``keys`` so that no key gathers in one task.

    ``lookup`` is broadcast while its measured size is within ``limit``. Beyond it, both are shuffled; the rows of a
    heavy key are cut into pieces, and the lookup rows of that key are repeated once per piece. ``how`` is a join kind
    that keeps rows of the left side only for themselves: inner, left, left_semi or left_anti. NULL keys match nothing
    and are cut into pieces like any other heavy key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join cannot do {how}")
    small = small_side(lookup, limit)
    if small is not lookup:
        return rows.join(small, keys, how)
    spark = rows.sparkSession
    share = share or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy_keys(rows, keys, share)
    taken = {*rows.columns, *lookup.columns}
    piece = next(n for n in (f"{'_' * i}piece" for i in range(1, len(taken) + 2)) if n not in taken)

    def with_pieces(side: DataFrame) -> DataFrame:
        named = F.broadcast(heavy.withColumnsRenamed({k: f"_heavy_{i}" for i, k in enumerate(keys)}))
        same = [side[k].eqNullSafe(named[f"_heavy_{i}"]) for i, k in enumerate(keys)]
        joined = side.join(named, same, "left")
        return joined.drop(*[f"_heavy_{i}" for i in range(len(keys))])

    count = F.coalesce(F.col("_pieces"), F.lit(1))
    left = with_pieces(rows).withColumn(piece, F.pmod(F.monotonically_increasing_id(), count).cast("int"))
    right = with_pieces(lookup).withColumn(piece, F.explode(F.sequence(F.lit(0), count - 1)))
    return left.drop("_pieces").join(right.drop("_pieces"), [*keys, piece], how).drop(piece)
