"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordlens.session import discard, materialize, scratch_path


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component): the smallest node each node is linked to, for nodes with a link to another.

    ``edges`` has two bigint columns, a and b. Every round is two aggregates that combine before the shuffle
    and two joins on their result, and ends in a written table, so neither lineage nor any task holds more
    than a share of the edges. Neighbour lists are never gathered. An empty graph gives an empty result.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, "components")
    proper = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    current, before = materialize(proper, "0", folder), None
    for step in range(1, limit + 1):
        stars = materialize(_small_star(_large_star(current)), str(step), folder)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if step > 1:
            discard(spark, f"{folder}/{step - 1}")
        current = stars
        if tuple(state) == before:
            return current.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
                current.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
            )
        before = tuple(state)
    raise RuntimeError(f"components did not settle in {limit} rounds")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the smallest of u and its neighbours."""
    both = pairs.select(F.col("v").alias("u"), F.col("m").alias("n")).unionByName(
        pairs.select(F.col("m").alias("u"), F.col("v").alias("n"))
    )
    least = both.groupBy("u").agg(F.min("n").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.where("n > u").join(least, "u").select(F.col("n").alias("v"), F.col("least").alias("m")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """All neighbours below v, and v itself, are linked to the smallest of them."""
    least = pairs.groupBy("v").agg(F.min("m").alias("least"))
    joined = pairs.join(least, "v")
    return (
        joined.select(F.col("m").alias("v"), F.col("least").alias("m"))
        .unionByName(least.select("v", F.col("least").alias("m")))
        .where("v <> m")
        .distinct()
    )
