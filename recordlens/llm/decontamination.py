"""Benchmark decontamination: words of documents that lie inside passages of benchmark items.

Words are runs of ASCII letters (A-Z in lower case), digits and characters beyond ASCII. An item is cut into its windows of
``WINDOW`` consecutive words; a shorter item is one window. A document contains a window where the same words stand in the
same order. This is a set containment join of windows with documents, by the prefix filter:

1. A window's elements are its shingles of ``SHINGLE`` words. All documents are read once to count the shingles that
   windows have. A containment of 1 needs every shingle of the window, so the necessary prefix is one: the rarest. A window
   with a shingle that no document has is done.
2. The documents are read again for the prefix shingles. Each hit carries the words around it, at most a window to either
   side, and joins the windows with that prefix.
3. A candidate must fit by position and length: as many words before the shingle as the window has, and as many after.
   Then the words are compared in full, so hashes decide nothing.

While documents are read, a bitmap passes over shingles that no window has. Its size is bounded whatever the benchmark's:
beyond ``common.MOST_BITS`` more shingles pass it by chance and meet nothing in the join. Windows are broadcast while they are
small and joined in pieces beyond that, so a passage that a third of all rows hold does not gather in one task. Texts are
read in blocks of about ``HELD_BYTES`` whatever the Arrow batch holds, and a text beyond that in parts with the words around
them, so the arrays of a task have a bounded size; per hit it holds the words around it only.

Defined cases: null texts have no words. Texts and items without words match nothing. Rows with one item_id are one item,
with the windows of all of them; a null item_id marks hits, but is not counted or listed. Repeated rows are documents of
their own. Extra columns of the documents, of any name, are kept by ``find`` and ``clean``. An empty table of documents
gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from recordlens.llm.common import bitmap, passing
from recordlens.operators.joins import spread_join
from recordlens.session import materialize, scratch_path

WINDOW, SHINGLE = 10, 3
BLOCK = 1 << 18
HELD_BYTES = 1 << 20  # of text, for which a task has arrays at once; for words of one letter these take about 45 times as much
# A byte of a word in lower case; all others become spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_LOW = np.frombuffer(WORD_BYTES, np.uint8)
_VALUES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.append(np.ones(1, np.uint64), np.full(BLOCK, _BASE, np.uint64)), dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Texts:
    """The words of the texts of one Arrow column, in a row: where they begin and end, and of which text they are."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        size = int(offsets[-1] - offsets[0])
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if size else np.empty(0, np.uint8)
        self.low = _LOW[raw]
        cuts = offsets - offsets[0]
        inside = self.low != 32
        joined = inside[1:] & inside[:-1]
        edges = cuts[(cuts > 0) & (cuts < size)] - 1
        joined[edges] = False  # no word crosses from one text to the next
        self.start = np.flatnonzero(inside & ~np.concatenate([[False], joined])) if size else np.empty(0, np.int64)
        self.end = np.flatnonzero(inside & ~np.concatenate([joined, [False]])) + 1 if size else np.empty(0, np.int64)
        # Words before each text, and one entry for the end.
        self.first = np.searchsorted(self.start, cuts)
        self.raw = self.low.tobytes()

    def words(self, low: int, high: int) -> bytes:
        """Words low to high (exclusive) with single spaces; they must be of one text."""
        return b" ".join(self.raw[self.start[low] : self.end[high - 1]].split()) if high > low else b""

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, in blocks of bounded size."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            low = self.start[at]
            stop = max(at + 1, int(np.searchsorted(self.end, low + BLOCK, "right")))
            high = self.end[stop - 1]
            if high - low > BLOCK:  # a single word of over a block
                digest = hashlib.blake2b(self.raw[low:high], digest_size=8).digest()
                out[at] = int.from_bytes(digest, "little")
            else:
                sums = np.append(np.zeros(1, np.uint64), np.cumsum(_VALUES[self.low[low:high]] * _POWERS[: high - low]))
                begin, end = self.start[at:stop] - low, self.end[at:stop] - low
                out[at:stop] = (sums[end] - sums[begin]) * _POWERS[BLOCK - begin]
            at = stop
        return _mixed(out)

    def shingles(self, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, hash) of all shingles of each width that lie in one text."""
        hashes = self.hashes()
        of_text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        for width in widths:
            n = len(hashes) - width + 1
            if n <= 0:
                continue
            value = np.full(n, width, np.uint64)
            for k in range(width):
                value = value * np.uint64(_BASE) + hashes[k : n + k]
            at = np.flatnonzero(of_text[:n] == of_text[width - 1 :])
            yield at, _mixed(value[at])


@dataclass
class Block:
    """Some rows of an Arrow column, or a part of the text of one row."""

    rows: slice
    texts: Texts
    own: slice  # the words that are no other block's; a part has words of its neighbours around them
    before: int  # words of the text in the parts before this one
    last: bool  # no part of the text follows

    def shingles(self, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, hash) of the shingles that begin with an own word."""
        for at, value in self.texts.shingles(widths):
            mine = slice(*np.searchsorted(at, [self.own.start, self.own.stop]))
            yield at[mine], value[mine]


def blocks(column: pa.Array, around: int, size: int = HELD_BYTES) -> Iterator[Block]:
    """The texts of a column in order, about ``size`` bytes at once; parts have ``around`` words more to either side."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        if offsets[high] - offsets[low] > size:
            raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[low] : offsets[high]]
            yield from _parts(raw, slice(low, high), around, size)
        else:
            texts = Texts(column.slice(low, high - low))
            yield Block(slice(low, high), texts, slice(0, len(texts.start)), 0, True)
        low = high


def _parts(raw: np.ndarray, rows: slice, around: int, size: int) -> Iterator[Block]:
    low = at = before = 0  # first byte of the words around, first own byte, words before
    while at < len(raw):
        stop = _gap(raw, at + size)
        reach = 64 * around
        while True:
            end = _gap(raw, stop + reach)
            inside = _LOW[raw[stop:end]] != 32  # begins in a gap, so each word has a first byte after another
            if end == len(raw) or np.count_nonzero(inside[1:] & ~inside[:-1]) >= around:
                break
            reach *= 2
        texts = Texts(pa.array([raw[low:end].tobytes()], pa.large_binary()))
        own = slice(*np.searchsorted(texts.start, [at - low, stop - low]).tolist())
        yield Block(rows, texts, own, before, stop == len(raw))
        low = low + int(texts.start[max(0, own.stop - around)]) if own.stop else stop
        at, before = stop, before + own.stop - own.start


def _gap(raw: np.ndarray, at: int) -> int:
    """The first place from ``at`` that no word covers, or the end."""
    while at < len(raw):
        found = np.flatnonzero(_LOW[raw[at : at + BLOCK]] == 32)
        if len(found):
            return at + int(found[0])
        at += BLOCK
    return len(raw)


def _windows_of(window: int, shingle: int, block: int):
    """Items (item_id, text) to their windows with the shingles of each in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in ((b.column("item_id"), x) for b in batches for x in blocks(b.column("text"), window, block)):
            texts = found.texts
            by_width = {}
            for width in range(1, shingle + 1):
                value = np.zeros(len(texts.start), np.uint64)
                for at, hashed in texts.shingles([width]):
                    value[at] = hashed
                by_width[width] = value.view(np.int64)
            item, words, n, shingles = [], [], [], []
            for i, own in enumerate(ids[found.rows].to_pylist()):
                low, high = int(texts.first[i]), int(texts.first[i + 1])
                size = min(window, high - low)
                width = min(shingle, size)
                for at in range(max(low, found.own.start), min(high - size + 1, found.own.stop) if size else low):
                    item.append(own)
                    words.append(texts.words(at, at + size))
                    n.append(size)
                    shingles.append(by_width[width][at : at + size - width + 1])
                    if len(item) >= 4096:
                        yield _window_batch(item, words, n, shingles)
                        item, words, n, shingles = [], [], [], []
            if item:
                yield _window_batch(item, words, n, shingles)

    return cut


def _window_batch(item, words, n, shingles) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "item": pa.array(item, pa.string()),
            "words": pa.array(words, pa.binary()).view(pa.string()),
            "n": pa.array(n, pa.int32()),
            "shingles": pa.array([s.tolist() for s in shingles], pa.list_(pa.int64())),
        }
    )


def windows_of(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = HELD_BYTES) -> DataFrame:
    """(item, words, n, shingles) of every window of every item."""
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInArrow(_windows_of(window, shingle, block), "item string, words string, n int, shingles array<bigint>")


def _count_shingles(held: bytes, widths: list[int], block: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held, np.uint8)
        for texts in (x for batch in batches for x in blocks(batch.column("text"), max(widths, default=0), block)):
            for _, value in texts.shingles(widths):
                found, n = np.unique(value[passing(value, bits)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return count


CANDIDATES = T.ArrayType(
    T.StructType().add("shingle", "long").add("at", "integer").add("before", "integer").add("words", "string")
)


_FOUND = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.string())])


def _find_shingles(held: bytes, widths: list[int], window: int, block: int):
    """Rows (row, text) to rows (row, n_words, candidates); a candidate has the words around it and how many lie before."""

    def of_block(found: Block, bits: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
        """The text of each candidate of a block, and the candidates."""
        texts = found.texts
        hits = [(at[p], value[p]) for at, value in found.shingles(widths) if len(p := np.flatnonzero(passing(value, bits)))]
        at = np.concatenate([h[0] for h in hits]) if hits else np.empty(0, np.int64)
        value = np.concatenate([h[1] for h in hits]) if hits else np.empty(0, np.uint64)
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order].view(np.int64)
        text = np.searchsorted(texts.first, at, "right") - 1
        low = np.maximum(texts.first[text], at - window + 1)
        high = np.minimum(texts.first[text + 1], at + window)
        words = [texts.words(a, b) for a, b in zip(low.tolist(), high.tolist())]
        columns = [
            pa.array(value, pa.int64()),
            pa.array(at - texts.first[text] - found.own.start + found.before, pa.int32()),
            pa.array(at - low, pa.int32()),
            pa.array(words, pa.binary()).view(pa.string()),
        ]
        return text, pa.StructArray.from_arrays(columns, fields=list(_FOUND))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held, np.uint8)
        parts: list[pa.StructArray] = []
        for rows, found in ((b.column("row"), x) for b in batches for x in blocks(b.column("text"), window, block)):
            text, entries = of_block(found, bits)
            rows = rows[found.rows]
            parts.append(entries)
            if not found.last:
                continue
            if found.before or len(parts) > 1:
                counts, offsets = [found.before + found.own.stop - found.own.start], [0, sum(map(len, parts))]
            else:
                counts, offsets = np.diff(found.texts.first), np.searchsorted(text, np.arange(len(rows) + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts))
            parts = []
            yield pa.RecordBatch.from_arrays([rows, pa.array(counts, pa.int64()), lists], names=["row", "n_words", "candidates"])

    return find


def _prefixes(docs: DataFrame, windows: DataFrame, widths: list[int], folder: str, block: int) -> DataFrame:
    """(number, words, n, shingle, offset): the windows all of whose shingles occur, each with the rarest of them."""
    shingles = materialize(windows.select(F.explode("shingles").alias("shingle")).distinct(), "shingles", folder)
    count = _count_shingles(bitmap(shingles, "shingle"), widths, block)
    counted = docs.select("text").mapInArrow(count, "shingle bigint, n bigint")
    counted = counted.groupBy("shingle").agg(F.sum("n").alias("often"))
    often = materialize(counted.join(shingles, "shingle", "left_semi"), "often", folder)
    places = windows.select("number", F.posexplode("shingles").alias("offset", "shingle"), F.size("shingles").alias("due"))
    places = materialize(places, "places", folder)
    known = spread_join(places, often, ["shingle"])
    rarest = known.groupBy("number", "due").agg(
        F.count("*").alias("seen"), F.min(F.struct("often", "shingle", "offset")).alias("rarest")
    )
    chosen = rarest.where("seen = due").select("number", "rarest.shingle", "rarest.offset")
    return windows.select("number", "words", "n").join(chosen, "number")


def find(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, keep: list[str] | None = None,
    block: int = HELD_BYTES,
) -> DataFrame:
    """Per document ``row`` (a struct of its columns), n_words, ``spans`` (word ranges that are hit, end exclusive) and ``items``.

    ``items`` are the sorted ids of the items whose windows occur in it. ``keep`` names the columns that ``row`` has, all
    by default; without the text, little is written and shuffled.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "decontamination")
    by_item = materialize(windows_of(items, window, shingle, block).distinct(), "windows", folder)
    windows = by_item.groupBy("words", "n", "shingles").agg(F.count("*").alias("items"))
    windows = materialize(windows.withColumn("number", F.monotonically_increasing_id()), "numbered", folder)
    widths = [r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().orderBy(1).collect()]  # at most SHINGLE values
    prefixes = materialize(_prefixes(docs, windows, widths, folder, block), "prefixes", folder)
    held = bitmap(prefixes.select("shingle").distinct(), "shingle")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col("text").alias("text"))
    # A schema object, as names of columns may hold any character.
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("candidates", CANDIDATES)])
    read = rows.mapInArrow(_find_shingles(held, widths, window, block), schema)
    read = materialize(read.withColumn("uid", F.monotonically_increasing_id()), "read", folder)
    candidates = read.where(F.size("candidates") > 0).select("uid", F.inline("candidates"))
    candidates = materialize(candidates.withColumnRenamed("words", "around"), "candidates", folder)
    joined = spread_join(candidates, prefixes, ["shingle"])
    around = F.split("around", " ")
    fits = (F.col("before") >= F.col("offset")) & (F.size(around) - F.col("before") >= F.col("n") - F.col("offset"))
    begin = F.col("before") - F.col("offset")
    same = F.array_join(F.slice(around, begin + 1, F.col("n")), " ") == F.col("words")
    low = F.col("at") - F.col("offset")
    hits = joined.where(F.when(fits, same).otherwise(F.lit(False)))
    hits = materialize(hits.select("uid", "number", low.alias("low"), (low + F.col("n")).alias("high")), "hits", folder)
    ranges = hits.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("ranges"))
    of_items = by_item.where("item is not null").join(windows.select("words", "number"), "words").select("number", "item")
    met = spread_join(hits.select("uid", "number").distinct(), materialize(of_items, "items", folder), ["number"])
    # An item's windows follow one another, so pairs are made distinct with map-side combining before they are gathered.
    listed = met.select("uid", "item").distinct().groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = read.select("uid", "row", "n_words").join(ranges, "uid", "left").join(listed, "uid", "left")
    none = F.array().cast("array<string>")
    return out.select("row", "n_words", merged(F.col("ranges")).alias("spans"), F.coalesce("items", none).alias("items"))


def merged(ranges: Column) -> Column:
    """Maximal runs of sorted (low, high) ranges; null gives none."""
    kind = "struct<done:array<struct<low:int,high:int>>,low:int,high:int>"
    empty = F.lit(None).cast("int")
    start = F.struct(F.array().cast("array<struct<low:int,high:int>>").alias("done"), empty.alias("low"), empty.alias("high"))

    def step(acc: Column, x: Column) -> Column:
        closed = F.concat(acc["done"], F.array(F.struct(acc["low"].alias("low"), acc["high"].alias("high"))))
        return (
            F.when(acc["low"].isNull(), F.struct(acc["done"].alias("done"), x["low"].alias("low"), x["high"].alias("high")))
            .when(
                x["low"] <= acc["high"],
                F.struct(acc["done"].alias("done"), acc["low"].alias("low"), F.greatest(acc["high"], x["high"]).alias("high")),
            )
            .otherwise(F.struct(closed.alias("done"), x["low"].alias("low"), x["high"].alias("high")))
        )

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["low"].alias("low"), acc["high"].alias("high")))
        return F.when(acc["low"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], last))

    sorted_ranges = F.coalesce(ranges, F.array().cast("array<struct<low:int,high:int>>"))
    return F.aggregate(sorted_ranges, start.cast(kind), step, finish)


def report(docs: DataFrame, items: DataFrame, block: int = HELD_BYTES) -> DataFrame:
    """One row per document: words, words hit, items and the digest of their ids."""
    found = find(docs, items, keep=["doc_id"], block=block)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["high"] - s["low"])
    return found.select(
        "row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window of an item, with all their columns."""
    return find(docs, items).where(F.size("spans") == 0).select("row.*")
