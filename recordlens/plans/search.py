"""Hybrid search: one query, a table of queries, exact-id lookup, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordlens.functions.display import clamp01, percent_of_best
from recordlens.functions.links import choose_link
from recordlens.functions.text import id_number, id_to_int
from recordlens.functions.vectors import dot
from recordlens.operators.dedupe import dedupe_first
from recordlens.operators.scoring import BOOSTS, WEIGHTS, blend, keyword_score
from recordlens.operators.topk import batch_hits

DEFAULT_K, MAX_K = 5, 20  # fixed values: offered number of results


def clamp_k(k, most: int = MAX_K) -> int:
    """Number of results asked for by a user, at most ``most``; anything unreadable gives the default."""
    try:
        return max(1, min(most, int(k)))
    except (TypeError, ValueError):
        return DEFAULT_K


def score_rows(
    index: DataFrame, query: Column, vector: Column, weights=WEIGHTS, boosts=BOOSTS
) -> DataFrame:
    """The index with semantic, keyword and final score of one query."""
    keyword = keyword_score(
        query, F.col("work_item_id"), F.col("title"), F.col("semantic_text"), boosts
    )
    # A column of its own, as Spark takes no subquery inside a higher-order function.
    scored = index.withColumn("_query", vector).withColumns(
        {"semantic_score": dot(F.col("_query"), F.col("embedding")), "keyword_score": keyword}
    ).drop("_query")
    final = blend(F.col("semantic_score"), F.col("keyword_score"), weights)
    return scored.withColumn("final_score", final)


def result_columns() -> list[Column]:
    return [
        id_to_int(F.col("work_item_id")).alias("work_item_id"),
        F.col("title"),
        choose_link(F.col("bug_url"), F.col("link")).alias("link"),
        F.col("semantic_score"),
        F.col("keyword_score"),
        F.col("final_score"),
    ]


def _order() -> list[Column]:
    return [F.desc("final_score"), F.asc_nulls_last("_number"), F.asc("work_item_id")]


def _best_rows(index, query, k, embedder, vector, weights, boosts) -> DataFrame:
    if k < 1:
        raise ValueError("k must be at least 1")
    if vector is None:
        vector = embedder.query_vector(index.sparkSession, query)
    rows = index.select(
        "work_item_id", "title", "semantic_text", "link", "bug_url", "embedding"
    )
    scored = score_rows(rows, F.lit(query), vector, weights, boosts)
    slim = scored.drop("semantic_text", "embedding")
    slim = slim.withColumn("_number", id_number(F.col("work_item_id")))
    return slim.orderBy(*_order()).limit(k)


def search(
    index: DataFrame,
    query: str,
    k: int = DEFAULT_K,
    *,
    embedder=None,
    vector: Column | None = None,
    weights=WEIGHTS,
    boosts=BOOSTS,
) -> DataFrame:
    """Top k rows by blended score: one scan, k rows kept per task, merged at the end.

    The query vector comes from ``embedder`` or is given as ``vector``, such as a scalar subquery.
    """
    best = _best_rows(index, query, k, embedder, vector, weights, boosts)
    return best.select(*result_columns())


def search_batch(
    index: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *, embedder=None, **options
) -> DataFrame:
    """Top k rows for each row of ``queries(query_id, query[, embedding])``.

    Titles and links are fetched for the winners only. A query id that occurs twice is an error. An id that
    the index holds twice can win twice, each time with the details of its first row.
    """
    if "embedding" not in queries.columns:
        queries = embedder.embed(queries, "query")
    if queries.groupBy("query_id").count().where("count > 1").head(1):
        raise ValueError("query ids must be unique")
    hits = batch_hits(index, queries, k, **options)
    winners = hits.select("work_item_id").distinct()
    details = index.select("work_item_id", "title", "link", "bug_url").join(winners, "work_item_id", "left_semi")
    details = dedupe_first(details, "work_item_id")
    joined = hits.join(details, "work_item_id")
    return joined.select("query_id", "rank", *result_columns())


def lookup(index: DataFrame, query: str) -> DataFrame:
    """The record whose id is exactly the all-digit ``query``, scored 1; else no row."""
    q = query.strip()
    wanted = F.lit(q.isascii() and q.isdigit())
    one = F.lit(1.0)
    found = (
        index.where(wanted & (F.col("work_item_id") == q))
        .select("work_item_id", "title", "link", "bug_url")
        .orderBy("work_item_id", "title")
        .limit(1)
    )
    scored = found.withColumns(
        {"semantic_score": one, "keyword_score": one, "final_score": one}
    )
    return scored.select(*result_columns())


def search_front(
    index: DataFrame,
    query: str,
    k=DEFAULT_K,
    *,
    embedder=None,
    vector: Column | None = None,
    weights=WEIGHTS,
    boosts=BOOSTS,
    max_k: int = MAX_K,
) -> DataFrame:
    """Exact id first, hybrid search only when there is none, then presented.

    At most ``max_k`` results are shown, whatever ``k`` asks for.
    """
    q = query.strip()
    if not q:
        raise ValueError("query is empty")
    if q.isascii() and q.isdigit():
        exact = lookup(index, q)
        found = exact.collect()  # one row at most, so the index is read once
        if found:
            return present(index.sparkSession.createDataFrame(found, exact.schema))
    best = _best_rows(index, q, clamp_k(k, max_k), embedder, vector, weights, boosts)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*_order()))
    return present(best.withColumn("rank", rank).select("rank", *result_columns()))


def present(results: DataFrame, query_id: str | None = None) -> DataFrame:
    """Rank and relative match percentage of results, per query when there are several.

    ``results`` is a top-k set, so each window holds at most k rows. A ``rank`` it has is kept.
    """
    group = F.col(query_id) if query_id else F.lit(1)
    best = F.max(clamp01(F.col("final_score"))).over(Window.partitionBy(group))
    if "rank" not in results.columns:
        by_score = Window.partitionBy(group).orderBy(
            F.desc("final_score"), F.asc("work_item_id"), F.asc("title")
        )
        results = results.withColumn("rank", F.row_number().over(by_score))
    return results.withColumn("match", percent_of_best(clamp01(F.col("final_score")), best))
