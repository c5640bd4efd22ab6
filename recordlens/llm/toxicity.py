"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased, everything but letters becomes a space, and the set of n-grams of 3 to 5 characters
is hashed into 2**20 buckets. Over the labelled sample, each bucket gets the log ratio of its smoothed document
frequencies in the two classes; the buckets that deviate most from chance are kept, and a logistic
regression is fitted on the kept ones, each scaled by its ratio.

The sample is bounded: at most ``per_class`` labelled rows of either class, those with the smallest hash of
their id. Every text is scored whole, in segments that overlap by the n-gram length.

Defined cases: null or empty texts have no n-grams and score by the intercept alone. Null labels are left out;
several labels of one id count as the largest. Without rows of both classes the score is 0 (only 1: 1).
Repeated rows are scored one by one, extra columns stay as they are, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordlens.session import materialize, scratch_path

SIZES = (3, 4, 5)
BITS = 20
SEGMENT = 1 << 18


@dataclass(frozen=True)
class Model:
    """Buckets in use, their weights (ratio times coefficient) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """Code points below 65536 as they are when letters, else a space."""
    points = np.arange(1 << 16, dtype=np.uint32)
    letters = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
    return np.where(letters, points, 32).astype(np.uint32)


def _points(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 1 << 16, _plain()[np.minimum(raw, (1 << 16) - 1)], raw)


def bucket_blocks(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row number, bucket) of every n-gram, in blocks of bounded size; a pair may occur again."""
    gap = np.zeros(max(SIZES), np.uint32)
    parts, rows, size = [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        points = _points(text)
        for at in range(0, len(points), SEGMENT):
            piece = points[at : at + SEGMENT + max(SIZES) - 1]
            parts += [piece, gap]
            rows.append((row, len(piece) + len(gap)))
            size += len(piece)
            if size >= SEGMENT:
                yield from _hashed(parts, rows)
                parts, rows, size = [], [], 0
    if parts:
        yield from _hashed(parts, rows)


def _hashed(parts: list, rows: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    points = np.concatenate(parts).astype(np.uint64)
    owner = np.repeat([r for r, _ in rows], [n for _, n in rows])
    prime, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    rolled = points.copy()
    inside = points != 0
    for n in range(2, max(SIZES) + 1):
        rolled = rolled[:-1] * prime + points[n - 1 :]
        inside = inside[:-1] & (points[n - 1 :] != 0)
        if n in SIZES:
            at = np.flatnonzero(inside)
            mixed = (rolled[at] ^ (rolled[at] >> np.uint64(29))) * mix + np.uint64(n)
            yield owner[at], ((mixed * prime) >> np.uint64(64 - BITS)).astype(np.int32)


def bucket_sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The distinct buckets of every text."""
    for batch in texts:
        found: list[list] = [[] for _ in range(len(batch))]
        for rows, buckets in bucket_blocks(iter(batch)):
            pairs = np.unique(rows.astype(np.int64) << BITS | buckets)
            rows, buckets = pairs >> BITS, (pairs & ((1 << BITS) - 1)).astype(np.int32)
            ends = np.searchsorted(rows, np.arange(len(batch)), "right")
            for row in np.unique(rows):
                found[row].append(buckets[ends[row - 1] if row else 0 : ends[row]])
        yield pd.Series([np.unique(np.concatenate(x)) if x else np.empty(0, np.int32) for x in found])


def train(
    labelled: DataFrame, per_class: int = 2000, features: int = 8000, alpha: float = 1.0, least_surprise: float = 2.0
) -> Model:
    """Fit on rows (key, text, label 0/1); ``key`` decides which rows the bounded sample takes.

    A bucket is used when its document frequency in the classes is ``least_surprise`` standard deviations or
    more from the share of the classes; at most ``features`` buckets, the most surprising first.
    """
    spark = labelled.sparkSession
    chosen = None
    for label in (0, 1):
        part = labelled.where(F.col("label") == label).orderBy(F.xxhash64("key"), "text").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = chosen.select("label", F.pandas_udf(bucket_sets, "array<int>")("text").alias("buckets"))
    sample = materialize(sample, "sample", scratch_path(spark, "toxicity"))
    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    empty = np.empty(0)
    if not size.get(0) or not size.get(1):
        return Model(empty.astype(np.int64), empty, 40.0 if size.get(1) else -800.0)
    counts = (
        sample.select("label", F.explode("buckets").alias("bucket"))
        .groupBy("bucket")
        .agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("q"))
    )
    share = size[1] / (size[0] + size[1])
    expected = share * (F.col("p") + F.col("q"))
    ratio = F.log((F.col("p") + alpha) / (size[1] + 2 * alpha)) - F.log((F.col("q") + alpha) / (size[0] + 2 * alpha))
    surprise = F.abs(F.col("p") - expected) / F.sqrt(expected * (1 - share) + 1)
    best = counts.select("bucket", ratio.alias("ratio"), surprise.alias("surprise")).orderBy(F.desc("surprise"), "bucket")
    kept = best.where(F.col("surprise") >= least_surprise).limit(features).toPandas().sort_values("bucket")
    buckets, ratios = kept["bucket"].to_numpy(np.int64), kept["ratio"].to_numpy()
    rows = sample.select("label", _only(buckets)("buckets").alias("at")).toArrow().combine_chunks()
    places = rows.column("at").combine_chunks()
    lengths = np.diff(places.offsets.to_numpy())
    columns = places.flatten().to_numpy(zero_copy_only=False)
    labels = rows.column("label").to_numpy().astype(float)
    coefficients, intercept = _logistic(columns, lengths, labels, ratios)
    return Model(buckets, ratios * coefficients, intercept)


def _only(buckets: np.ndarray):
    """Positions of a set's members in the sorted buckets."""

    @F.pandas_udf("array<int>")
    def positions(sets: pd.Series) -> pd.Series:
        def one(found):
            found = np.asarray(found if len(buckets) else [], np.int64)
            at = np.minimum(np.searchsorted(buckets, found), len(buckets) - 1)
            return at[buckets[at] == found].astype(np.int32)

        return sets.map(one)

    return positions


def _logistic(columns: np.ndarray, lengths: np.ndarray, labels: np.ndarray, ratios: np.ndarray, l2=1.0, steps=300):
    """Full-batch Adam on the scaled presence features; plain logistic loss with an L2 term.

    Row i has the features ``columns`` lists for it, ``lengths[i]`` of them.
    """
    owner = np.repeat(np.arange(len(labels), dtype=np.int32), lengths)
    scaled = ratios[columns]
    w = np.zeros(len(ratios) + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = np.bincount(owner, scaled * w[columns], len(labels)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels
        slope = np.append(np.bincount(columns, scaled * error[owner], len(ratios)), error.sum())
        slope[:-1] += l2 * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _ranges(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about a segment of characters together."""
    low = size = 0
    for high, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= SEGMENT or high == len(texts):
            yield low, high
            low, size = high, 0


def _scorer(model: Model, spark: SparkSession):
    """Scores of a column of texts, as a function for tasks."""
    shared = spark.sparkContext.broadcast((model.buckets, model.weights, model.intercept))

    def scores(texts: pa.Array) -> np.ndarray:
        buckets, weights, intercept = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[buckets] = weights
        used = table != 0
        margin = np.full(len(texts), intercept)
        values = texts.to_pylist()
        for low, high in _ranges(values):
            hits = np.empty(0, np.int64)
            for rows, found in bucket_blocks(iter(values[low:high])):
                hit = used[found]
                hits = np.unique(np.concatenate([hits, rows[hit].astype(np.int64) << BITS | found[hit]]))
            margin[low:high] += np.bincount(hits >> BITS, table[hits & ((1 << BITS) - 1)], high - low)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    return scores


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null stays null."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def train_on(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model:
    """Fit on the documents that ``labels`` (doc_id, toxic) covers, without every fifth by hash."""
    usable = labels.where("toxic is not null and doc_id is not null").where(remainder(F.col("doc_id"), 5) != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    picked = None
    for label in (0, 1):  # ids only; at most per_class rows of each class, so the broadcast is bounded
        part = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return train(rows.select(F.col("doc_id").alias("key"), "text", "label"), per_class)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1 for every row."""
    scores = _scorer(model, docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(scores(batch.column(1)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id bigint, score double")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    return score(docs, model).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with their columns unchanged."""
    scores = _scorer(model, docs.sparkSession)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text")) < threshold))

    return docs.mapInArrow(kept, docs.schema)
