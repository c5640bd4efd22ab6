"""Joins that spread hot keys, and positions in a global sort."""

import pytest
from pyspark.sql import functions as F

from recordlens.operators.joins import heavy_keys, spread_join
from recordlens.operators.ordering import with_positions


def rows_of(spark, tmp_path, n=3000):
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
        (F.col("id") % 2).alias("part"), F.col("id").alias("value"),
    )
    df.write.mode("overwrite").parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def lookup_of(spark, tmp_path):
    keys = [("hot", 0, "a"), ("hot", 1, "b"), ("hot", 1, "c"), (None, 0, "n"), *[(f"k{i}", i % 2, "x") for i in range(0, 3000, 7)]]
    spark.createDataFrame(keys, "key string, part long, piece string").write.mode("overwrite").parquet(str(tmp_path / "lookup"))
    return spark.read.parquet(str(tmp_path / "lookup"))


def heavy_of(rows):
    return {(r["key"], r["part"], r["_pieces"]) for r in heavy_keys(rows, ["key", "part"], 10).collect()}


def test_heavy_keys(spark, tmp_path):
    # Each of the four heavy pairs holds a sixth of the rows: 10 shares of it are cut in two.
    assert heavy_of(rows_of(spark, tmp_path)) == {(k, p, 2) for k in ("hot", None) for p in (0, 1)}
    assert heavy_of(rows_of(spark, tmp_path).limit(0)) == set()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_a_plain_join(spark, tmp_path, how):
    rows, lookup = rows_of(spark, tmp_path), lookup_of(spark, tmp_path)
    want = rows.join(lookup, ["key", "part"], how)
    for limit in (-1, 1 << 20):
        found = spread_join(rows, lookup, ["key", "part"], how, limit=limit, share=10)
        assert found.columns == want.columns
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError):
        spread_join(rows, lookup, ["key"], "full")


def test_no_task_gathers_a_hot_key(spark, tmp_path):
    rows, lookup = rows_of(spark, tmp_path, 30_000), lookup_of(spark, tmp_path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for key, value in zip(before, ("false", "-1", "16")):
        spark.conf.set(key, value)
    try:
        found = spread_join(rows, lookup, ["key", "part"], "left", limit=-1, share=64)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        plain = rows.join(lookup, ["key", "part"], "left")
        largest = max(r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect())
        assert max(sizes) < largest / 2 and sum(sizes) == plain.count()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_positions(spark, tmp_path):
    rows = rows_of(spark, tmp_path)
    found = with_positions(rows, [F.desc("value")], "place").collect()
    assert [r["place"] for r in sorted(found, key=lambda r: -r["value"])] == list(range(3000))
    grouped = with_positions(rows, [F.asc("value")], group="key").collect()
    by_key = {}
    for r in sorted(grouped, key=lambda r: r["value"]):
        by_key.setdefault(r["key"], []).append(r["position"])
    assert len(by_key) == 1002 and all(v == list(range(len(v))) for v in by_key.values())
    assert with_positions(rows.limit(0), [F.asc("value")]).count() == 0
