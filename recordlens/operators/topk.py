"""Exact top-k of many queries over a whole index.

Every query is compared with every row, so the work is a matrix product. A task reads its share
of the index in Arrow batches, multiplies it with a block of queries and keeps only k rows per
query. Which rows are kept is exact: the fast product only preselects within its error bound,
and the survivors are scored again with the left-to-right sum the rest of the engine uses.

A query table within the block bounds is shipped to the tasks. A larger one is written to the shared folder in blocks, and
each block in turn is shipped and meets the index in one scan: a block nested scan. So texts and vectors of the index are
never shuffled, whatever the number of queries; the index is read once per block, and the driver holds one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from recordlens.functions.text import id_number, strip
from recordlens.operators.scoring import BOOSTS, WEIGHTS
from recordlens.session import materialize, scratch_path

BLOCK_QUERIES = 4096
BLOCK_BYTES = 64 << 20
BLOCK_ROWS = 16384
SCORE_CELLS = 4 << 20
SHORT_TEXT = 4
BROADCAST_HITS = 200_000
_NO_NUMBER = np.iinfo(np.int64).max

_HITS = (
    "query_id string, work_item_id string, semantic_score double, keyword_score double, "
    "final_score double"
)


def top_per_query(hits: DataFrame, k: int, salts: int = 32) -> DataFrame:
    """Best k hits per query in two steps, so no query's hits gather in one task at once."""
    order = (F.desc("final_score"), F.asc_nulls_last("_number"), F.asc("work_item_id"))
    salt = F.pmod(F.xxhash64("work_item_id"), F.lit(salts))
    partial = Window.partitionBy("query_id", "_salt").orderBy(*order)
    final = Window.partitionBy("query_id").orderBy(*order)
    reduced = (
        hits.withColumns({"_salt": salt, "_number": id_number(F.col("work_item_id"))})
        .withColumn("rank", F.row_number().over(partial))
        .where(F.col("rank") <= k)
    )
    ranked = reduced.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.drop("_salt", "_number")


def batch_hits(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    weights=WEIGHTS,
    boosts=BOOSTS,
    block_queries: int = BLOCK_QUERIES,
    block_bytes: int = BLOCK_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k hits of ``queries(query_id, query, embedding)`` over the index, ranked.

    Query ids and record ids are unique. The work is quadratic, pairs of queries and rows; a query table beyond the block
    bounds reads the index once per query block, so the index should be stored.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        strip("query").alias("query"),
        F.lower(strip("query")).alias("lowered"),
        F.col("embedding").alias("vector"),
    )
    rows = index.select(
        "work_item_id",
        id_number(F.col("work_item_id")).alias("number"),
        F.lower("title").alias("title"),
        F.lower("semantic_text").alias("body"),
        F.col("embedding").alias("vector"),
    )
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(_bytes_of_query()).alias("b")).first()
    if size.n <= block_queries and (size.b or 0) <= block_bytes:
        hits = top_per_query(_against_shipped_queries(rows, asked, k, weights, boosts, block_rows), k)
        # At most k hits for each of the counted queries; beyond the bound Spark chooses.
        return F.broadcast(hits) if size.n * k <= BROADCAST_HITS else hits
    parts = max(math.ceil(size.n / block_queries), math.ceil(size.b / block_bytes))
    folder = scratch_path(rows.sparkSession, "query-blocks")
    for number, block in enumerate(_query_blocks(asked, parts, block_queries, block_bytes, folder)):
        found = top_per_query(_against_shipped_queries(rows, block, k, weights, boosts, block_rows), k)
        found.write.parquet(f"{folder}/hits/block={number}")
    # Every query is in one block, so its hits are ranked already.
    return rows.sparkSession.read.parquet(f"{folder}/hits").drop("block")


def _query_blocks(asked: DataFrame, parts: int, most: int, most_bytes: int, folder: str) -> Iterator[DataFrame]:
    """The queries in blocks, read from a table that is written once.

    A block is a run of hash buckets whose measured rows and bytes are within both bounds. A bucket that is over one by
    itself is cut by its ids into even parts.
    """
    buckets = F.pmod(F.xxhash64("query_id"), F.lit(parts * 8)).cast("int")
    sized = asked.withColumns({"_bucket": buckets, "_bytes": _bytes_of_query().cast("bigint")})
    stored = materialize(sized, "queries", folder)
    # A row per bucket, eight times as many as blocks.
    found = stored.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")).orderBy("_bucket").collect()
    held: list[int] = []
    n = size = 0
    for bucket in [*found, None]:
        if bucket is None or (held and (n + bucket.n > most or size + bucket.b > most_bytes)):
            if held:
                yield stored.where(F.col("_bucket").between(held[0], held[-1])).drop("_bytes", "_bucket")
            held, n, size = [], 0, 0
        if bucket is not None:
            if bucket.n > most or (bucket.n > 1 and bucket.b > most_bytes):
                yield from _cut_bucket(stored, bucket, most, most_bytes)
                continue
            held, n, size = [*held, bucket._bucket], n + bucket.n, size + bucket.b


def _cut_bucket(stored: DataFrame, bucket, most: int, most_bytes: int) -> Iterator[DataFrame]:
    """Blocks of a bucket that is over a bound by itself: its query ids in order, cut where a bound is met."""
    rows = stored.where(F.col("_bucket") == bucket._bucket)
    pieces = max(-(-bucket.n // most), -(-bucket.b // most_bytes))
    step = max(1, bucket.n // pieces)
    ordered = rows.select("query_id").orderBy("query_id").toArrow()["query_id"]  # ids of one bucket, about an eighth of a block
    for at in range(0, len(ordered), step):
        low, high = ordered[at].as_py(), ordered[min(at + step, len(ordered)) - 1].as_py()
        yield rows.where(F.col("query_id").between(low, high)).drop("_bytes", "_bucket")


def _bytes_of_query():
    return F.coalesce(F.octet_length("query"), F.lit(0)) * 2 + F.size("vector") * 8


def _against_shipped_queries(rows, asked, k, weights, boosts, block_rows) -> DataFrame:
    spark = rows.sparkSession
    # Bounded: batch_hits has checked the number and the bytes of the queries.
    block = QueryBlock.from_arrow(asked.toArrow())
    # Plain values, as a broadcast pickles classes by name and workers need not have this package.
    shipped = spark.sparkContext.broadcast(astuple(block))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(QueryBlock(*shipped.value), k, weights, boosts)
        for batch in batches:
            best.add(batch, block_rows)
        yield best.result()

    return rows.mapInArrow(score, _HITS)


@dataclass
class QueryBlock:
    """Queries of one block; ``text_of`` numbers their distinct texts, the last number is none."""

    ids: list[str]
    exact: dict[str, list[int]]
    texts: list[str]
    text_of: np.ndarray
    matrix: np.ndarray

    @classmethod
    def from_arrow(cls, table: pa.Table) -> "QueryBlock":
        exact: dict[str, list[int]] = {}
        numbers: dict[str, int] = {}
        for i, q in enumerate(table["query"].to_pylist()):
            if q:
                exact.setdefault(q, []).append(i)
        lowered = table["lowered"].to_pylist()
        for text in lowered:
            if text:
                numbers.setdefault(text, len(numbers))
        text_of = np.array([numbers.get(t, len(numbers)) for t in lowered], dtype=np.int64)
        return cls(
            table["query_id"].to_pylist(), exact, list(numbers), text_of, _matrix(table["vector"])
        )


def _matrix(column) -> np.ndarray:
    """Rows of one list column as a matrix; unequal lengths and NULLs are errors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten()
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if column.null_count or flat.null_count or len(lengths) != 1:
        raise ValueError("vectors must be non-NULL and of one length")
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = matrix.reshape(len(column), lengths[0])
    if not np.isfinite(matrix).all():
        raise ValueError("vectors must be finite")
    return matrix


class TextMatcher:
    """Which of the query texts occur in a text, each text scanned about once."""

    def __init__(self, texts: list[str]):
        try:
            import ahocorasick
        except ImportError:
            ahocorasick = None
        # Short texts occur all over; a plain search for them stops at the first hit.
        plain = [n for n, t in enumerate(texts) if not ahocorasick or len(t) < SHORT_TEXT]
        self.plain = [(n, texts[n]) for n in plain]
        self.automaton = None
        if len(plain) < len(texts):
            self.automaton = ahocorasick.Automaton()
            for n in set(range(len(texts))).difference(plain):
                self.automaton.add_word(texts[n], n)
            self.automaton.make_automaton()

    def found(self, text: str) -> set[int]:
        hits = {n for n, t in self.plain if t in text}
        if self.automaton is not None:
            hits.update(n for _, n in self.automaton.iter(text))
        return hits


class Best:
    """The k best rows per query among the batches seen so far."""

    def __init__(self, block: QueryBlock, k: int, weights, boosts):
        self.block, self.k, self.weights, self.boosts = block, k, weights, boosts
        self.matcher = TextMatcher(block.texts)
        self.id_set = pa.array(list(block.exact), pa.string())
        self.query = np.zeros(0, np.int64)
        self.number = np.zeros(0, np.int64)
        self.ident = np.zeros(0, object)
        self.semantic = self.keyword = self.final = np.zeros(0)
        self.worst_kept = np.full(len(block.ids), -np.inf)
        # Norms bound the rounding error of the product in whatever order it is summed.
        self.query_norm = np.sqrt((block.matrix**2).sum(axis=1))

    def add(self, batch: pa.RecordBatch, most_rows: int = BLOCK_ROWS) -> None:
        step = max(1, min(most_rows, SCORE_CELLS // max(1, len(self.block.ids))))
        for start in range(0, batch.num_rows, step):
            self._add(batch.slice(start, step))

    def _add(self, batch: pa.RecordBatch) -> None:
        if not self.block.ids:
            return
        rows = _matrix(batch.column("vector"))
        matrix = self.block.matrix
        if rows.shape[1] != matrix.shape[1]:
            raise ValueError(f"vector length {rows.shape[1]} differs from {matrix.shape[1]}")
        keyword = self._keyword(batch)
        rough = self.weights[0] * (matrix @ rows.T) + self.weights[1] * keyword
        scale = self.query_norm[:, None] * np.sqrt((rows**2).sum(axis=1))[None, :]
        slack = 4e-16 * (rows.shape[1] + 8) * (abs(self.weights[0]) * scale.max(axis=1) + 2.0)
        bar = self.worst_kept - slack
        if rough.shape[1] > self.k:
            kth = np.partition(rough, rough.shape[1] - self.k, axis=1)[:, -self.k]
            bar = np.maximum(bar, kth - 2 * slack)
        q, r = np.nonzero(rough >= bar[:, None])
        exact = np.zeros(len(q))
        for d in range(rows.shape[1]):
            exact += matrix[q, d] * rows[r, d]
        hit = keyword[q, r]
        number = batch.column("number").fill_null(_NO_NUMBER).to_numpy()
        ident = np.array(batch.column("work_item_id").to_pylist(), dtype=object)
        self._keep(q, number[r], ident[r], exact, hit)

    def _keyword(self, batch: pa.RecordBatch) -> np.ndarray:
        score = np.zeros((len(self.block.ids), batch.num_rows))
        where = pc.index_in(batch.column("work_item_id"), value_set=self.id_set)
        for r in np.flatnonzero(where.is_valid().to_numpy(zero_copy_only=False)):
            score[self.block.exact[self.id_set[where[r].as_py()].as_py()], r] += self.boosts[0]
        for name, boost in (("title", self.boosts[1]), ("body", self.boosts[2])):
            hits = [
                (n, r)
                for r, text in enumerate(batch.column(name).to_pylist())
                if text
                for n in self.matcher.found(text)
            ]
            if hits:
                by_text = np.zeros((len(self.block.texts) + 1, batch.num_rows))
                by_text[tuple(np.array(hits).T)] = boost
                score += by_text[self.block.text_of]
        return score

    def _keep(self, query, number, ident, semantic, keyword) -> None:
        query = np.concatenate([self.query, query])
        number = np.concatenate([self.number, number])
        ident = np.concatenate([self.ident, ident])
        semantic = np.concatenate([self.semantic, semantic])
        keyword = np.concatenate([self.keyword, keyword])
        final = self.weights[0] * semantic + self.weights[1] * keyword
        order = np.lexsort((ident.astype(str), number, -final, query))
        query = query[order]
        first = np.searchsorted(query, np.arange(len(self.block.ids)))
        place = np.arange(len(query)) - first[query]
        kept = order[place < self.k]
        self.query, self.number, self.ident = query[place < self.k], number[kept], ident[kept]
        self.semantic, self.keyword, self.final = semantic[kept], keyword[kept], final[kept]
        place = place[place < self.k]
        full = place == self.k - 1
        self.worst_kept[self.query[full]] = self.final[full]

    def result(self) -> pa.RecordBatch:
        ids = np.array(self.block.ids, dtype=object)
        return pa.RecordBatch.from_pydict(
            {
                "query_id": pa.array(ids[self.query] if len(ids) else [], pa.string()),
                "work_item_id": pa.array(self.ident, pa.string()),
                "semantic_score": pa.array(self.semantic, pa.float64()),
                "keyword_score": pa.array(self.keyword, pa.float64()),
                "final_score": pa.array(self.final, pa.float64()),
            }
        )
