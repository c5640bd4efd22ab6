"""Suffix-array dedup: bytes inside strings of ``length`` bytes that start more than once are removed.

Sorting all suffixes of a corpus against each other would move every text many times, so equal strings are first
brought together, and suffix arrays are built where they meet:

1. Each start p is tied to the anchor of its string: the leftmost smallest hash of the short grams inside it.
   Equal strings have their anchor at the same distance. Consecutive starts with one anchor, cut in two by that
   distance, form a piece; all strings of a piece share a core of over half their length, whose hash is the piece's key.
   One row per piece (about one per 110 bytes) is counted; keys that occur once are done. Nothing is sampled: every
   start is in exactly one piece, and equal strings are in pieces of equal keys.
2. Pieces with equal bytes are merged and counted; all strings of a piece that occurs twice are repeated.
3. The distinct pieces of a key that has several get a suffix array by two-stage sorting: only suffixes that are smaller
   than their successor are sorted directly, all others are induced from them by a scan over the buckets of
   first bytes. Common prefixes of neighbours then tell which starts are repeated.

A key with more than ``most_pieces`` distinct pieces (a passage that a third of all rows hold, with different
surroundings) is split instead: each of its starts becomes a row with the digest of its string, counted with map-side
combining. So a task never holds more than a bounded group. Rows per document are bounded by its length.

Defined cases: null is the empty text; texts shorter than ``length`` lose nothing. Matches never cross texts. Repeated rows
are separate texts, so each repeats the other. Extra columns are ignored by the report and kept by ``remove_repeats``, where
characters of which a byte is removed vanish as a whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordlens.llm.common import UID, bitmap, fields, numbered_rows, passing, runs
from recordlens.operators.joins import spread_join
from recordlens.session import discard, materialize, scratch_path

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 20
TABLE = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SORTED_AT_ONCE = 1 << 19


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of all substrings of a text of at most CHUNK + length bytes."""

    def __init__(self, raw: np.ndarray):
        room = 1 << max(12, int(len(raw)).bit_length())
        self.inverse = _powers(INVERSE, room)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[raw] * _powers(BASE, room)[: len(raw)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def pieces(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, key, hash of the bytes) of the pieces of one text."""
    found = [_chunk_pieces(raw[at : at + CHUNK + length - 1], length, at) for at in range(0, max(1, len(raw) - length + 1), CHUNK)]
    return tuple(np.concatenate(column) for column in zip(*found))


def _chunk_pieces(raw: np.ndarray, length: int, offset: int) -> tuple[np.ndarray, ...]:
    starts = len(raw) - length + 1
    if starts <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    gram = max(4, length // 12)
    window = length - gram + 1
    hashes = Hashes(raw)
    n = len(raw) - gram + 1
    at = np.arange(n)
    value = (hashes.of(at, at + gram) >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= window:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    least = np.minimum(value[:starts], value[window - span : window - span + starts])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    half = (window + 1) // 2
    far = (anchor - np.arange(starts)) >= half
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (far[1:] != far[:-1])]))
    many = np.diff(np.append(first, starts))
    anchor, far = anchor[first], far[first]
    # All strings of a piece hold the bytes from the last possible start to the end of the first possible one.
    core_start = np.where(far, anchor - half, anchor)
    core_end = np.where(far, anchor - (window - 1), anchor - (half - 1)) + length
    key = _mixed(hashes.of(core_start, core_end) + far.astype(np.uint64))
    whole = hashes.of(first, first + many + length - 1)
    whole = _mixed(whole + _mixed(many.astype(np.uint64) << np.uint64(32) | (anchor - first).astype(np.uint64)))
    return first + offset, many, key.view(np.int64), whole.view(np.int64)


def suffix_array(text: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the needed suffixes, sorted by their first ``depth`` bytes, in two stages.

    ``needed`` must hold, with each suffix that is larger than its successor, the suffixes after it up to the next
    one that is smaller than its successor.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    known = np.flatnonzero(step)
    after = np.searchsorted(known, np.arange(n - 1))
    smaller = np.zeros(n, bool)  # the last suffix is larger than the empty one
    inside = after < len(known)
    smaller[: n - 1][inside] = step[known[after[inside]]] > 0
    raw = text.tobytes()
    direct = np.flatnonzero(smaller & needed).tolist()
    direct.sort(key=lambda p: raw[p : p + depth])
    direct = np.array(direct, np.int64)
    heads = text[direct]
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))
    larger = needed & ~smaller
    out = []
    for byte in range(256):
        own = induced[byte]
        wave = np.concatenate(own) if own else np.empty(0, np.int64)
        low = [wave]
        while len(wave):  # runs of one byte: each suffix places the one before it in the same bucket
            before = wave - 1
            before = before[before >= 0]
            wave = before[larger[before] & (text[before] == byte)]
            low.append(wave)
        bucket = np.concatenate([*low, direct[np.searchsorted(heads, byte, "left") : np.searchsorted(heads, byte, "right")]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[larger[before] & (text[before] > byte)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            induced[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the next one in order, at most ``depth`` bytes; all have that many."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), np.dtype(">u8"), padded.tobytes(), strides=(1,))
    common = np.zeros(max(0, len(order) - 1), np.int64)
    alive = np.arange(len(common))
    for at in range(0, depth, 8):
        a, b = words[order[alive] + at].astype(np.uint64), words[order[alive + 1] + at].astype(np.uint64)
        differ = a ^ b
        equal = differ == 0
        first = 7 - np.floor(np.log2(np.maximum(differ, np.uint64(1)).astype(np.float64) * (1 + 2**-52))).astype(np.int64) // 8
        common[alive] += np.where(equal, 8, first)
        alive = alive[equal]
        if not len(alive):
            break
    return np.minimum(common, depth)


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For every segment, which of its starts of full strings also start elsewhere in the segments."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(segments), np.uint8)
    begin = np.cumsum(sizes) - sizes
    real = np.zeros(len(text), bool)
    for b, size in zip(begin.tolist(), sizes.tolist()):
        real[b : b + size - length + 1] = True
    order = suffix_array(text, _closed(text, real), length)
    order = order[real[order]]
    equal = common_prefixes(text, order, length) >= length
    twice = np.zeros(len(text), bool)
    twice[order[:-1][equal]] = True
    twice[order[1:][equal]] = True
    return [twice[b : b + size - length + 1] for b, size in zip(begin.tolist(), sizes.tolist())]


def _closed(text: np.ndarray, real: np.ndarray) -> np.ndarray:
    """The real starts and what their sorting needs: all up to the next suffix smaller than its successor."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    known = np.flatnonzero(step)
    rises = known[step[known] > 0]
    # The suffixes smaller than their successor are those in or at the end of a flat stretch that leads to a rise.
    stop = np.searchsorted(rises, np.arange(n))
    until = np.where(stop < len(rises), rises[np.minimum(stop, max(len(rises) - 1, 0))] if len(rises) else n - 1, n - 1)
    ends = np.flatnonzero(real & ~np.append(real[1:], False))
    needed = np.zeros(n + 1, np.int64)
    begins = np.flatnonzero(real & ~np.concatenate([[False], real[:-1]]))
    np.add.at(needed, begins, 1)
    np.add.at(needed, until[ends] + 1, -1)
    return np.cumsum(needed[:n]) > 0


def _starts_to_ranges(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _find_keys(length: int):
    """Texts to the keys of their pieces."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [pieces(_bytes_of(text), length)[2] for text in batch.column(0)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])

    return find


def _bytes_of(text) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _find_pieces(length: int, held: bytes):
    """Texts to those of their pieces whose key passes the bitmap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held, np.uint8)
        for batch in batches:
            uids = batch.column(0).to_numpy()
            columns, sizes = [], []
            for text in batch.column(1):
                found = pieces(_bytes_of(text), length)
                often = passing(found[2].view(np.uint64), bits)
                columns.append([column[often] for column in found])
                sizes.append(int(often.sum()))
            if columns:
                first, many, key, whole = (np.concatenate(c) for c in zip(*columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(uids, sizes)), pa.array(first), pa.array(many, pa.int32()), pa.array(key), pa.array(whole)],
                    names=[UID, "first", "many", "key", "whole"],
                )

    return find


def _cut(length: int):
    """Documents with their list of pieces to rows: the bytes of a piece, or for split keys a digest per start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "whole", "at", "bytes", "digest"]
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                out: list[list] = [[] for _ in names]
                for piece in wanted.as_py():
                    key, whole, first, many = piece["key"], piece["whole"], piece["first"], piece["many"]
                    if not piece["split"]:
                        for column, value in zip(out, (key, whole, -1, raw[first : first + many + length - 1], None)):
                            column.append(value)
                        continue
                    for at in range(many):
                        string = raw[first + at : first + at + length]
                        digest = hashlib.blake2b(string, digest_size=16).digest()
                        for column, value in zip(out, (key, whole, at, None, digest)):
                            column.append(value)
                if out[0]:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return cut


def _sort_groups(length: int):
    """Rows sorted by key to (key, whole, from, to): ranges of repeated starts, relative to the piece's first."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            keys, wholes, froms, tos = [], [], [], []
            for key, whole, marked in zip(held_keys, held_wholes, repeated_starts(held, length)):
                low, high = _starts_to_ranges(marked)
                keys += [key] * len(low)
                wholes += [whole] * len(low)
                froms.append(low)
                tos.append(high)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(wholes, pa.int64()),
                    pa.array(np.concatenate(froms), pa.int32()),
                    pa.array(np.concatenate(tos), pa.int32()),
                ],
                names=["key", "whole", "from", "to"],
            )

        held, held_keys, held_wholes, size = [], [], [], 0
        for table in runs(batches, ["key"]):
            found = table.column("bytes").to_pylist()
            held += found
            held_keys += table.column("key").to_pylist()
            held_wholes += table.column("whole").to_pylist()
            size += sum(map(len, found))
            if size >= SORTED_AT_ONCE:
                yield flush()
                held, held_keys, held_wholes, size = [], [], [], 0
        if held:
            yield flush()

    return sort


def repeated_ranges(rows: DataFrame, folder: str, length: int = 400, most_pieces: int = 4000) -> DataFrame:
    """uid and its byte ranges (array of struct low, high, end exclusive) that are inside repeated strings.

    ``rows`` are numbered rows with a text column, written below ``folder``; those without such ranges have no row. The keys
    are counted first, so only pieces whose key occurs twice are ever written with their places; tables are deleted once
    the next one is written.
    """
    spark = rows.sparkSession

    def done(*names: str) -> None:
        for name in names:
            discard(spark, f"{folder}/{name}")

    keys = rows.select("text").mapInArrow(_find_keys(length), "key bigint")
    often = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often", folder)
    passed = rows.select(UID, "text").mapInArrow(
        _find_pieces(length, bitmap(often, "key")), f"{UID} bigint, first bigint, many int, key bigint, whole bigint"
    )
    passed = materialize(passed, "passed", folder)
    shared = materialize(spread_join(passed, often, ["key"], "left_semi"), "shared", folder)
    done("passed", "often")
    distinct = materialize(
        shared.groupBy("key", "whole").agg(
            F.count("*").alias("copies"), F.first(UID).alias(UID), F.first("first").alias("first"), F.first("many").alias("many")
        ),
        "distinct",
        folder,
    )
    several = distinct.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = (
        distinct.join(several, "key")
        .groupBy(UID)
        .agg(
            F.collect_list(
                F.struct("key", "whole", "first", "many", (F.col("kinds") > most_pieces).alias("split"))
            ).alias("wanted")
        )
    )
    cut = rows.join(wanted, UID).select("text", "wanted").mapInArrow(
        _cut(length), "key bigint, whole bigint, at int, bytes binary, digest binary"
    )
    cut = materialize(cut, "cut", folder)
    by_sorting = (
        cut.where("at < 0")
        .select("key", "whole", "bytes")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_sort_groups(length), "key bigint, whole bigint, from int, to int")
    )
    starts = cut.where("at >= 0").select("key", "whole", "at", "digest")
    twice = starts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    ats = F.array_sort(F.collect_list("at"))  # at most the starts of one piece
    heads = F.filter("ats", lambda x: ~F.array_contains("ats", x - 1))
    tails = F.filter("ats", lambda x: ~F.array_contains("ats", x + 1))
    by_digest = (
        starts.join(twice, "digest")
        .groupBy("key", "whole")
        .agg(ats.alias("ats"))
        .select("key", "whole", F.inline(F.arrays_zip(heads.alias("from"), tails.alias("to"))))
    )
    partly = by_sorting.unionByName(by_digest)
    whole = distinct.where("copies > 1").select(
        "key", "whole", F.lit(0).alias("from"), (F.col("many") - 1).alias("to")
    )
    single = distinct.where("copies = 1").select("key", "whole")
    repeated = materialize(whole.unionByName(partly.join(single, ["key", "whole"], "left_semi")), "repeated", folder)
    done("distinct", "cut")
    ranges = (
        spread_join(shared.select(UID, "first", "key", "whole"), repeated, ["key", "whole"])
        .select(
            UID,
            F.struct(
                (F.col("first") + F.col("from")).alias("low"), (F.col("first") + F.col("to") + length).alias("high")
            ).alias("range"),
        )
        .groupBy(UID)
        .agg(F.array_sort(F.collect_list("range")).alias("ranges"))
    )
    ranges = materialize(ranges, "ranges", folder)
    done("shared", "repeated")
    return ranges


def merged(ranges) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for r in ranges:
        low, high = r["low"], r["high"]
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _outside(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for low, high in spans:
        kept.append(raw[at:low])
        at = high
    return b"".join([*kept, raw[at:]])


def apply_ranges(docs: DataFrame, length: int = 400) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``) and ``cut``: kept (binary, what is left), n_bytes, n_removed, n_spans."""

    def remove(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, ranges):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans = merged(found) if found is not None else []
            out.append((_outside(raw, spans), len(raw), sum(h - low for low, h in spans), len(spans)))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    cut = F.pandas_udf(remove, "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
    folder = scratch_path(docs.sparkSession, "suffixes")
    rows = numbered_rows(docs, folder)
    joined = rows.join(repeated_ranges(fields(rows, "text"), folder, length), UID, "left")
    return joined.select("row", cut("row.text", "ranges").alias("cut"))


def report(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per document: sizes, what is removed, and the digest of what is left."""
    return apply_ranges(docs.select("doc_id", "text"), length).select(
        "row.doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256")
    )


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` without the repeated bytes; a column n_chars, when there is one, follows the text."""

    def text_of(kept: pd.Series) -> pd.Series:
        return kept.map(lambda raw: raw.decode("utf-8", "ignore"))

    text = F.when(F.col("cut.n_removed") > 0, F.pandas_udf(text_of, "string")("cut.kept")).otherwise(F.col("row.text"))
    out = apply_ranges(docs, length).select("row", text.alias("left"))
    changed = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
