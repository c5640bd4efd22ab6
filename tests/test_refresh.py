"""Build, refresh, store and stream."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from recordlens.embedders import HashEmbedder
from recordlens.operators.cleaning import clean_records
from recordlens.operators.dedupe import dedupe_first, dedupe_last
from recordlens.operators.quality import dimension_range, is_normalized, row_alignment, unaligned_ids
from recordlens.plans.build import build_index, make_index, renormalize_index
from recordlens.plans.refresh import (
    diff_counts,
    fingerprint_audit,
    fingerprint_merge,
    refresh,
    refresh_delta,
    snapshot_diff,
)
from recordlens.sources.store import (
    load_index,
    next_version,
    overlay,
    publish_delta,
    publish_index,
    versions,
)
from recordlens.streaming.refresh import apply_changes, start_refresh_stream

EMBEDDER = HashEmbedder(8)
FEED = "BugID string, Title string, SemanticText string, BugUrl string, changed_at timestamp, seq long"
RECORDS = "WorkItemId string, Title string, SemanticText string, Tags string, link string"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("1", "one", "first", "t1", "l1"),
        ("2", "two", "second", "t2", "l2"),
        ("3", "three", None, None, "l3"),
    ]
    return build_index(spark.createDataFrame(rows, RECORDS), EMBEDDER).cache()


def feed(spark, *rows):
    return spark.createDataFrame(list(rows), FEED)


def by_id(df):
    return {r.work_item_id: r for r in df.collect()}


def test_clean_records(spark):
    rows = [
        ("1.0", " a ", "x", None, None), (None, "a", "x", None, None), ("2", None, "x", None, None),
        (" ", "a", "x", None, None), ("3", "a", " ", None, None), ("4", "", "", None, None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = {r.work_item_id: (r.title, r.semantic_text) for r in clean_records(df).collect()}
    assert got == {"1": ("a", "x"), "3": ("a", "a")}
    loose = {r.work_item_id for r in clean_records(df, drop_null_title=False).collect()}
    assert loose == {"1", "2", "3"}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="SemanticText"):
        clean_records(spark.createDataFrame([("1", "a")], "WorkItemId string, Title string"))


def test_numeric_ids_and_both_link_headers(spark):
    df = spark.createDataFrame([(12.0, "t", "s", "a", "b")], "WorkItemId double, Title string, SemanticText string, Link string, tags string")
    row = clean_records(df).first()
    assert (row.work_item_id, row.link, row.tags) == ("12", "a", "b")


def test_refresh_counts_and_rows(spark, index):
    changes = feed(
        spark,
        ("2", "two", "second", "u2", at(1), 1),
        ("3", "three", "changed", "u3", at(1), 2),
        ("3", "three", "older", "u0", at(0), 3),
        ("4.0", "four", None, None, at(1), 4),
        (None, "none", "x", None, at(1), 5),
        ("5", None, " ", None, at(1), 6),
    )
    done = refresh(index, changes, EMBEDDER)
    assert done.stats.first().asDict() == {"added": 1, "updated": 1, "skipped": 4}
    rows = by_id(done.index)
    assert set(rows) == {"1", "2", "3", "4"}
    assert (rows["3"].semantic_text, rows["3"].link, rows["3"].bug_url) == ("changed", "l3", "u3")
    assert rows["2"].bug_url is None and rows["4"].semantic_text == "four"
    assert rows["3"].fingerprint == hashlib.sha256(b"3|three|changed").hexdigest()
    again = refresh(done.index, changes, EMBEDDER)
    assert again.stats.first().asDict() == {"added": 0, "updated": 0, "skipped": 6}


def test_refresh_of_everything(spark, index):
    changes = feed(spark, ("2", "two", "second", "u2", at(1), 1))
    done = refresh(index, changes, EMBEDDER, skip_unchanged=False)
    assert done.stats.first().asDict() == {"added": 0, "updated": 1, "skipped": 0}
    assert by_id(done.index)["2"].bug_url == "u2"


def test_snapshot_refresh_replaces_the_columns_it_has(spark, index):
    rows = [("1", "one", "new", "t9", None), ("2", "two", "second", None, None), ("6", None, "x", None, None)]
    done = refresh(index, spark.createDataFrame(rows, RECORDS), EMBEDDER, full_table=True)
    assert done.stats.first().asDict() == {"added": 0, "updated": 1, "skipped": 2}
    row = by_id(done.index)["1"]
    assert (row.tags, row.link) == ("t9", None)


def test_make_index(spark, index):
    records = spark.createDataFrame([("1", "a", "x", None, None), ("2", "b", "y", None, None)], RECORDS)
    pairs = make_index(records, index.where("work_item_id = '1'"), strict=False)
    assert [r.work_item_id for r in pairs.collect()] == ["1"]
    with pytest.raises(ValueError, match="out of step"):
        make_index(records, index)
    assert make_index(records, index.where("work_item_id < '3'")).count() == 2


def test_empty_feed(spark, index):
    done = refresh(index, feed(spark).limit(0), EMBEDDER)
    assert done.stats.first().asDict() == {"added": 0, "updated": 0, "skipped": 0}
    assert done.index.count() == 3


def test_tags_count_only_when_asked(spark):
    old = spark.createDataFrame([("1", "t", "s", "x", None)], RECORDS)
    new = spark.createDataFrame([("1", "t", "s", "y", None)], RECORDS)
    for include, updated in ((False, 0), (True, 1)):
        index = build_index(old, EMBEDDER, include_tags=include)
        stats = refresh(index, new, EMBEDDER, include_tags=include).stats.first()
        assert stats.updated == updated


def test_other_dimension_is_refused(spark, index):
    with pytest.raises(ValueError, match="dimension"):
        refresh(index, feed(spark, ("9", "a", "b", None, at(1), 1)), HashEmbedder(9))


def test_snapshot_diff(spark, index):
    rows = [("1", "one", "first", None, None), ("2.0", "two", "new text", None, None), ("9", "n", "n", None, None)]
    diff = snapshot_diff(index, spark.createDataFrame(rows, RECORDS))
    assert {r.work_item_id: r.status for r in diff.collect()} == {
        "1": "unchanged", "2": "modified", "9": "new",
    }
    assert diff_counts(diff).first().asDict() == {
        "new": 1, "modified": 1, "unchanged": 1, "changed": True,
    }


def test_fingerprint_merge_and_audit(spark, index):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "work_item_id string, fingerprint string")
    new = spark.createDataFrame([("2", ""), ("3", "c"), ("1", "z")], "work_item_id string, fingerprint string")
    merged = {r.work_item_id: r.fingerprint for r in fingerprint_merge(old, new).collect()}
    assert merged == {"1": "z", "2": "b", "3": "c"}
    snapshot = spark.createDataFrame([("1.0", "one", "first", None, None), ("8", "x", "y", None, None)], RECORDS)
    audit = {r.plain_id: r for r in fingerprint_audit(snapshot, index).collect()}
    assert (audit["1.0"].id_known, audit["1.0"].matches, audit["1.0"].plain_id_known) == (True, True, False)
    assert not audit["8"].id_known and not audit["8"].matches


def test_dedupe_of_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("seq"), F.lit("x").alias("v"),
    )
    assert dedupe_last(df, "k", "seq").where("k = 'hot'").first().seq == 2997
    assert dedupe_first(df, "k", "seq").where("k = 'hot'").first().seq == 0
    assert dedupe_last(df, "k", "seq").count() == 2001


def test_quality(spark, index):
    assert is_normalized(index).first()[0] and is_normalized(index.limit(0)).first()[0]
    assert dimension_range(index).first().asDict() == {"min_dim": 8, "max_dim": 8, "consistent": True}
    scaled = index.withColumn("embedding", F.transform("embedding", lambda x: (x * 3).cast("float")))
    assert not is_normalized(scaled).first()[0]
    assert is_normalized(renormalize_index(scaled)).first()[0]
    fewer = index.where("work_item_id <> '1'")
    assert row_alignment(index, index).first().aligned
    assert not row_alignment(index, fewer).first().aligned
    assert [tuple(r) for r in unaligned_ids(index, fewer).collect()] == [("1", "vector")]


def test_store_versions(spark, index, tmp_path):
    base = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        load_index(spark, base)
    assert publish_index(index, base) == 1
    delta = index.where("work_item_id = '1'").withColumn("title", F.lit("uno"))
    assert publish_delta(delta, base, "a") == 2
    assert publish_delta(delta.withColumn("title", F.lit("eins")), base, "b") == 3
    # A retry of the first delta keeps its number and stays below the second.
    assert publish_delta(delta, base, "a") == 2
    assert by_id(load_index(spark, base))["1"].title == "eins"
    assert by_id(load_index(spark, base, 2))["1"].title == "uno"
    assert by_id(load_index(spark, base, 1))["1"].title == "one"
    assert publish_index(load_index(spark, base), base) == 4
    assert by_id(load_index(spark, base))["1"].title == "eins"
    # A folder without the marker of a finished write is not read.
    (tmp_path / "store" / "deltas" / "v0000000005").mkdir()
    assert [v.committed for v in versions(spark, base)] == [True] * 4 + [False]
    assert load_index(spark, base).count() == 3
    assert next_version(versions(spark, base)) == 6


def test_overlay_with_and_without_broadcast(spark, index, tmp_path):
    index.write.parquet(str(tmp_path / "i"))
    index.where("work_item_id < '3'").withColumn("title", F.lit("x")).write.parquet(str(tmp_path / "d"))
    stored, delta = (spark.read.parquet(str(tmp_path / n)) for n in ("i", "d"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = overlay(stored, delta), overlay(stored, delta, limit=0)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (few, many)]
        assert "BroadcastHashJoin" in plans[0] and "Exchange hashpartitioning" not in plans[0]
        assert "SortMergeJoin" in plans[1]
        assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
        assert {r.work_item_id: r.title for r in few.collect()} == {"1": "x", "2": "x", "3": "three"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_refresh_reads_few_columns_of_the_index(spark, index, tmp_path):
    base = str(tmp_path / "narrow")
    publish_index(index, base)
    changes = feed(spark, ("2", "two", "other", None, at(1), 1))
    apply_changes(base, changes, EMBEDDER)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    delta = refresh_delta(load_index(spark, base), changes, EMBEDDER)
    plan = delta._jdf.queryExecution().executedPlan().toString()
    scans = [part.split("\n")[0] for part in plan.split("ReadSchema: ")[1:]]
    of_index = [s for s in scans if "fingerprint" in s and "title" not in s]
    assert len(of_index) == 2  # snapshot and delta
    assert not any("semantic_text" in s or "embedding" in s for s in of_index)
    # Neither of them is shuffled on the way to the ids of the feed.
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan


def test_apply_changes_can_be_repeated(spark, index, tmp_path):
    base = str(tmp_path / "apply")
    publish_index(index, base)
    changes = feed(spark, ("2", "two", "other", None, at(1), 1), ("7", "x", "y", None, at(1), 2))
    for _ in range(2):
        stats = apply_changes(base, changes, EMBEDDER, tag="once")
        assert stats == {"added": 1, "updated": 1, "skipped": 0}
    assert len(versions(spark, base)) == 2 and load_index(spark, base).count() == 4
    assert apply_changes(base, changes, EMBEDDER) == {"added": 0, "updated": 0, "skipped": 2}
    nothing = spark.createDataFrame([], FEED)
    assert apply_changes(base, nothing, EMBEDDER) == {"added": 0, "updated": 0, "skipped": 0}


def test_stream_in_many_batches_equals_one_batch(spark, tables, tmp_path):
    from workload import inputs as given

    feed_rows = given.changes(spark, tables)
    parts = str(tmp_path / "feed")
    days = [r[0] for r in feed_rows.select(F.to_date("changed_at")).distinct().orderBy(1).collect()]
    step = max(1, len(days) // 4)
    for start in range(0, len(days), step):
        some = feed_rows.where(F.to_date("changed_at").isin(days[start : start + step]))
        some.coalesce(1).write.mode("append").parquet(parts)
    base = str(tmp_path / "base")
    start = build_index(feed_rows.limit(0), EMBEDDER)
    publish_index(start, base)
    stream = spark.readStream.schema(feed_rows.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    for _ in range(2):  # the second run finds nothing new
        running = start_refresh_stream(stream, base, EMBEDDER, str(tmp_path / "progress"))
        assert running.awaitTermination(300)
    assert len(versions(spark, base)) >= 4
    want = refresh(start, feed_rows, EMBEDDER).index
    columns = ["work_item_id", "title", "semantic_text", "fingerprint", "embedding"]
    got = load_index(spark, base).select(columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(columns).collect()))


def test_batches_in_any_order_end_in_the_last_state(spark, index, tmp_path):
    base = str(tmp_path / "order")
    publish_index(index, base)
    vector = by_id(load_index(spark, base))["2"].embedding
    steps = [
        (("2", "two", "second", None, at(1), 1), 0),  # confirms the stored row, which has no time
        (("2", "two", "second", None, at(9), 5), 0),  # confirms it later
        (("2", "two", "between", None, at(5), 3), 0),  # and a change before that arrives late
        (("2", "two", "after", None, at(10), 6), 1),
    ]
    for row, updated in steps:
        stats = apply_changes(base, feed(spark, row), EMBEDDER)
        assert stats == {"added": 0, "updated": updated, "skipped": 1 - updated}
        stored = by_id(load_index(spark, base))["2"]
        if not updated:
            assert (stored.semantic_text, stored.tags, stored.link, stored.embedding) == ("second", "t2", "l2", vector)
    assert stored.semantic_text == "after" and load_index(spark, base).count() == index.count()


def test_every_vector_is_checked(spark, index):
    odd = index.limit(1).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(ValueError, match="dimension mismatch"):
        refresh(index.unionByName(odd), feed(spark), EMBEDDER)


def test_an_id_stored_twice_is_updated_once(spark, index):
    changes = feed(spark)
    doubled = index.unionByName(index.limit(2))
    once, twice = refresh(index, changes, EMBEDDER), refresh(doubled, changes, EMBEDDER)
    assert once.stats.first() == twice.stats.first()
    assert once.delta.count() == twice.delta.count()
