"""Variable-capacity best-fit packing of texts into training sequences of several permitted lengths.

Texts are measured in words and cut into pieces of at most the largest capacity. What best-fit decreasing needs to know
of a corpus is how many pieces there are of each length, a table no longer than the largest capacity:

1. Pieces are counted by length (combined before the shuffle).
2. The plan is made on those counts. Lengths are taken from the largest down; equal pieces go, many at a time, to
   the open bins with the least room that still holds them. When none is open, bins are opened of the size with the
   least cost per packed word, where a bin costs its capacity plus ``overhead``. At the end each bin is downsized
   to the smallest capacity that holds its contents. The plan's size depends on the capacities, not on the corpus.
3. Pieces of one length are numbered, in salted groups with offsets, and the number tells the bin and the place in it.

Defined cases: null and blank texts have no words and no row. Repeated rows are packed each. A null id is kept. Extra columns
are ignored; an empty table gives an empty result. ``docs`` must be a table scan or otherwise repeatable.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from recordlens.llm.common import UID, with_uid
from recordlens.llm.quality_rules import words_of
from recordlens.session import materialize, scratch_path

CAPACITIES = (512, 1024, 2048, 4096)
PLAN = "length int, ord_low bigint, ord_high bigint, per_bin bigint, bin_low bigint, place int"
BINS = "bin_low bigint, bin_high bigint, bin_size int, used int"


def plan_bins(counts: dict[int, int], capacities: Sequence[int], overhead: int) -> tuple[list[tuple], list[tuple]]:
    """Rows of PLAN and of BINS for so many pieces of each length; ranges exclude their high end.

    Bins with equal contents are one range of numbers, so the work does not grow with the number of pieces.
    """
    sizes = sorted(capacities)
    rooms: list[int] = []  # the room of open ranges, sorted
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room -> ranges (low, high, used)
    placed, closed, next_bin = [], [], 0

    def put(low: int, high: int, used: int, room: int) -> None:
        if high <= low:
            return
        if room == 0:
            closed.append((low, high, used))
            return
        if room not in open_bins:
            insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append((low, high, used))

    for length in sorted((n for n, count in counts.items() if count > 0), reverse=True):
        left, ordinal = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                low, high, used = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                fitting = [c for c in sizes if c >= length]
                size = min(fitting, key=lambda c: ((c + overhead) / (min(c // length, left) * length), c))
                each = min(size // length, left)
                low, high, used, room = next_bin, next_bin + max(1, left // each), 0, size
                next_bin = high
            each = min(room // length, left)
            full = min(high - low, left // each)
            placed.append((length, ordinal, ordinal + full * each, each, low, used))
            put(low, low + full, used + each * length, room - each * length)
            put(low + full, high, used, room)
            ordinal += full * each
            left -= full * each
    closed += [r for ranges in open_bins.values() for r in ranges]
    bins = [(low, high, next(c for c in sizes if c >= used), used) for low, high, used in sorted(closed) if used]
    return placed, bins


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """uid, doc_id, piece, first_word, length of every piece of at most ``longest`` words."""
    counted = with_uid(docs.select("doc_id", "text")).select(
        UID, "doc_id", F.size(words_of(F.coalesce("text", F.lit("")))).alias("words")
    )
    numbers = F.sequence(F.lit(0), F.floor((F.col("words") - 1) / longest).cast("int"))
    return (
        counted.where("words > 0")
        .select(UID, "doc_id", "words", F.explode(numbers).alias("piece"))
        .select(
            UID,
            "doc_id",
            "piece",
            (F.col("piece") * longest).alias("first_word"),
            F.least(F.col("words") - F.col("piece") * longest, F.lit(longest)).alias("length"),
        )
    )


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = 16, salts: int = 64) -> DataFrame:
    """doc_id, piece, first_word, n_words, bin_id, bin_size, place for every piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "packing")
    salt = F.pmod(F.xxhash64(UID, "piece"), F.lit(salts)).cast("int")
    parts = materialize(pieces(docs, max(capacities)).withColumn("salt", salt), "pieces", folder)
    # At most (largest capacity x salts) rows, and the largest capacity many on the driver.
    by_salt = materialize(parts.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts", folder)
    counts = {r.length: r.n for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed, bins = plan_bins(counts, capacities, overhead)
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("length", "salt").orderBy(UID, "piece")
    numbered = (
        parts.withColumn("nth", F.row_number().over(order) - 1)
        .join(offsets, ["length", "salt"])
        .withColumn("ordinal", F.col("nth") + F.col("ahead"))
    )
    plan = _sized_plan(placed, bins)
    table = spark.createDataFrame(plan, PLAN + ", bin_size int")
    within = (F.col("ordinal") >= F.col("ord_low")) & (F.col("ordinal") < F.col("ord_high"))
    step = F.col("ordinal") - F.col("ord_low")
    joined = numbered.join(F.broadcast(table.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & within)
    return joined.select(
        "doc_id",
        "piece",
        "first_word",
        F.col("length").alias("n_words"),
        (F.col("bin_low") + F.floor(step / F.col("per_bin"))).cast("long").alias("bin_id"),
        "bin_size",
        (F.col("place") + step % F.col("per_bin") * F.col("length")).cast("int").alias("place"),
    )


def _sized_plan(placed: list[tuple], bins: list[tuple]) -> list[tuple]:
    """Plan rows cut where the final size of their bins changes."""
    starts = [b[0] for b in bins]
    out = []
    for length, low, high, each, first, place in placed:
        at = bisect_left(starts, first + 1) - 1
        while low < high:
            bin_low, bin_high, size, _ = bins[at]
            many = min(bin_high - first, (high - low) // each)
            out.append((length, low, low + many * each, each, first, place, size))
            low, first, at = low + many * each, first + many, at + 1
    return out
