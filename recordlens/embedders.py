"""Text embedders: each turns a text column into a unit-length ``array<float>`` column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordlens.functions.vectors import MIN_NORM

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
BLOCK = 1 << 18  # tokens


class Embedder:
    """``dim`` is the vector length, None when only the model knows it."""

    dim: int | None = None

    def column(self, text: Column) -> Column:
        raise NotImplementedError

    def embed(self, df: DataFrame, text: str, output: str = "embedding") -> DataFrame:
        return df.withColumn(output, self.column(F.col(text)))

    def query_vector(self, spark: SparkSession, query: str) -> Column:
        """Vector of one query text as a scalar subquery: computed once, no action here."""
        one = spark.range(1, numPartitions=1)
        return one.select(self.column(F.lit(query)).alias("v")).scalar()


class HashEmbedder(Embedder):
    """Signed token hashing: lexical, deterministic, needs no model.

    Bucket and sign of a token come from its MD5. Spark splits the text; the task function gets
    Arrow batches, hashes each distinct token of a batch once and counts with NumPy, so there is
    no shuffle and no row per token.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.arrow_udf("array<float>")
        def hash_tokens(tokens: pa.Array) -> pa.Array:
            return _hash_vectors(tokens, dim)

        return hash_tokens(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK))


def _hash_vectors(tokens: pa.ListArray, dim: int, block: int = BLOCK) -> pa.ListArray:
    """Unit vectors of token lists. Tokens are counted ``block`` at a time, so that the wide arrays do not grow with the
    batch; the sums are whole numbers, so blocks change no bit of them."""
    n = len(tokens)
    ends = tokens.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    encoded = tokens.flatten().dictionary_encode()
    words = encoded.dictionary.to_pylist()
    digests = [hashlib.md5(w.encode()).hexdigest() for w in words]
    bucket = np.array([int(d[:8], 16) % dim for d in digests], dtype=np.int64)
    sign = np.array([0.0 if not w else 1.0 if d[8] < "8" else -1.0 for w, d in zip(words, digests)])
    codes = encoded.indices.to_numpy()
    sums = np.zeros((n, dim))
    for start in range(0, len(codes), block):
        code = codes[start : start + block]
        stop = start + len(code)
        # The rows from first to before last have tokens in this block.
        first, last = np.searchsorted(ends, start, "right") - 1, np.searchsorted(ends, stop, "left")
        row = np.repeat(np.arange(last - first), np.diff(np.clip(ends[first : last + 1], start, stop)))
        counted = np.bincount(row * dim + bucket[code], weights=sign[code], minlength=(last - first) * dim)
        sums[first:last] += counted.reshape(-1, dim)
    length = np.sqrt((sums * sums).sum(axis=1))
    unit = (sums / np.maximum(length, MIN_NORM)[:, None]).astype(np.float32)
    offsets = pa.array(np.arange(n + 1) * dim, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))
