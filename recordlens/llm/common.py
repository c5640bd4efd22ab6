"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordlens.session import materialize

UID = "__uid"
LEAST_BITS, MOST_BITS, BITS_PER_VALUE = 1 << 20, 1 << 27, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: inside ``body`` it is a variable, not an expression evaluated anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_uid(rows: DataFrame) -> DataFrame:
    """Number rows, so that repeated ids stay separate rows.

    The number is made of the partition and the position in it. Partitions follow the cores alive when a job
    is planned, so a second scan may number otherwise: use the numbers of one job only, or :func:`numbered`.
    """
    return rows.withColumn(UID, F.monotonically_increasing_id())


def numbered(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` written once below ``folder`` with their numbers, for results that later jobs join to them."""
    return materialize(with_uid(rows), "rows", folder)


def numbered_rows(docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` written once below ``folder``: the number and ``row``, a struct of all columns, so that no name can clash.

    Take fields from ``row`` where they are needed: a column beside it would be written and shuffled twice.
    """
    return numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), folder)


def fields(rows: DataFrame, *columns: str) -> DataFrame:
    """The number and some fields of numbered rows; a scan reads only these."""
    return rows.select(UID, *[F.col(f"row.{c}").alias(c) for c in columns])


def prefix_sums(values: Column, block: int = 512) -> Column:
    """Sums of all earlier elements, for arrays of any length, in two levels."""

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def within(arr: Column) -> Column:
        n = F.size(arr)
        blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(
            F.array().cast("array<int>")
        )
        sums = F.transform(blocks, lambda b: total(F.slice(arr, b * block + 1, F.lit(block))))

        def with_sums(s: Column) -> Column:
            before = F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
            return let(
                before,
                lambda p: F.transform(
                    arr,
                    lambda _, i: F.get(p, F.floor(i / block).cast("int"))
                    + total(F.slice(arr, F.floor(i / block).cast("int") * block + 1, i % block)),
                ),
            )

        return let(sums, with_sums)

    return let(values, within)


def bounded_batches(spark: SparkSession, rows: int = 4096, size: int = 16 << 20) -> None:
    """Bound the session's Arrow batches by rows and bytes, as texts may be long; both sides buffer whole batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def into_blocks(members: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Cut every group of ``keys`` into blocks and send each row to all pairs (i, j), i <= j, of its block.

    Groups of one row have nothing to compare and are left out. ``members`` has a bigint column ``node``.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    sizes = sizes.select(*keys, F.ceil(F.col("__n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least(other, F.col("own")).alias("i"),
            F.greatest(other, F.col("own")).alias("j"),
        ),
    )
    return (
        members.join(sizes, keys)
        .withColumn("own", own)
        .withColumn("pair", F.explode(pairs))
        .select("*", "pair.i", "pair.j")
        .drop("pair", "blocks")
    )


def block_components(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable in a symmetric boolean matrix."""
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        least = np.minimum(label, np.where(link, label[None, :], top).min(axis=1, initial=top))
        if (least == label).all():
            return label
        label = least


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by integer keys; a run may span batches."""
    held: list[pa.RecordBatch] = []

    def cuts(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for key in keys:
            column = table.column(key).to_numpy()
            change |= column[1:] != column[:-1]
        return np.flatnonzero(change) + 1

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        at = cuts(table)
        if not len(at):
            continue
        for low, high in zip(np.concatenate([[0], at[:-1]]).tolist(), at.tolist()):
            yield table.slice(low, high - low)
        held = table.slice(int(at[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            at = cuts(table).tolist()
            for low, high in zip([0, *at], [*at, table.num_rows]):
                yield table.slice(low, high - low)


def bitmap(values: DataFrame, column: str) -> bytes:
    """A bit set for every distinct bigint of ``column``, at the place of its lowest bits.

    It has ``BITS_PER_VALUE`` bits a value and never more than ``MOST_BITS`` (16 MB), so it may be shipped to tasks whatever
    the table's size. It only lets others pass: what passes must still be compared or joined.
    """
    n = values.count()
    bits = LEAST_BITS
    while bits < min(n * BITS_PER_VALUE, MOST_BITS):
        bits *= 2
    place = F.pmod(F.col(column), F.lit(bits))
    bytes_set = values.groupBy(F.shiftright(place, 3).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))).alias("set")
    )
    # As many rows as the bitmap has bytes, at most.
    found = bytes_set.toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[found["at"].to_numpy()] = found["set"].to_numpy()
    return out.tobytes()


def passing(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit values have their bit set in the bytes of a bitmap."""
    place = values & np.uint64(len(held) * 8 - 1)
    return (held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
