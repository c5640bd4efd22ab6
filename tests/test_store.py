"""The log of versions: attempts, readers, second writers, compaction, statistics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordlens.embedders import HashEmbedder
from recordlens.plans.build import build_index
from recordlens.plans.refresh import refresh_delta
from recordlens.sources import store
from recordlens.sources.store import StaleWrite, compact, load_index, publish_delta, publish_index, read_state, vacuum
from recordlens.streaming import refresh as streaming
from recordlens.streaming.refresh import apply_changes

EMBEDDER = HashEmbedder(8)
FEED = "BugID string, Title string, SemanticText string, changed_at timestamp, seq long"


def feed(spark, *rows):
    return spark.createDataFrame([(i, t, t + " body", dt.datetime(2024, 1, 1, 0, n), n) for i, t, n in rows], FEED)


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "index")
    publish_index(build_index(feed(spark, *[(str(i), f"t{i}", 0) for i in range(40)]), EMBEDDER), path)
    return path


def titles(spark, path, version=None):
    return {r.work_item_id: r.title for r in load_index(spark, path, version).collect()}


def test_many_deltas_stay_bounded_and_equal(spark, base):
    want = {str(i): f"t{i}" for i in range(40)}
    for n in range(1, 8):
        apply_changes(base, feed(spark, (str(n), f"new{n}", n), (f"x{n}", f"more{n}", n)), EMBEDDER, most_deltas=2)
        want |= {str(n): f"new{n}", f"x{n}": f"more{n}"}
        assert len(read_state(spark, base).deltas) <= 2
    assert titles(spark, base) == want
    kinds = [v.kind for v in store.versions(spark, base)]
    assert kinds.count("snapshots") >= 2  # the first and a fold, once the deltas held a quarter of the rows
    assert read_state(spark, base).dimensions == (8, 8)


def test_a_fold_keeps_deltas_that_come_meanwhile(spark, base, monkeypatch):
    for n in range(3):
        apply_changes(base, feed(spark, (str(n), f"new{n}", 1)), EMBEDDER)
    real = store._write

    def write_and_meanwhile(df, base_path, kind, number, tag):
        done = real(df, base_path, kind, number, tag)
        monkeypatch.setattr(store, "_write", real)
        apply_changes(base, feed(spark, ("5", f"meanwhile{kind}", 9), ("0", f"again{kind}", 9)), EMBEDDER)
        return done

    for share in (0.0, 1.0):  # as a snapshot, then as one delta
        monkeypatch.setattr(store, "_write", write_and_meanwhile)
        assert compact(spark, base, 1, share) is not None
        found = titles(spark, base)
        kind = "deltas" if share else "snapshots"
        assert (found["5"], found["0"], found["1"]) == (f"meanwhile{kind}", f"again{kind}", "new1")
        assert len(read_state(spark, base).deltas) == 1 + (share > 0)
        apply_changes(base, feed(spark, ("7", f"seven{share}", 4 + int(share))), EMBEDDER)


def test_a_reader_keeps_its_version(spark, base):
    before = load_index(spark, base)
    first = read_state(spark, base).version
    for n in range(4):
        apply_changes(base, feed(spark, ("1", f"new{n}", n + 1)), EMBEDDER, most_deltas=1)
    assert {r.title for r in before.where("work_item_id = '1'").collect()} == {"t1"}
    assert titles(spark, base, first)["1"] == "t1" and titles(spark, base)["1"] == "new3"


def test_a_retry_after_a_broken_write(spark, base, monkeypatch):
    real, calls = store._write, []

    def broken(df, base_path, kind, number, tag):
        done = real(df, base_path, kind, number, tag)
        calls.append(done)
        if len(calls) == 1:
            raise RuntimeError("lost before the commit")
        return done

    monkeypatch.setattr(store, "_write", broken)
    changes = feed(spark, ("1", "new", 1), ("y", "y", 1))
    with pytest.raises(RuntimeError):
        apply_changes(base, changes, EMBEDDER, tag="batch-1")
    assert titles(spark, base)["1"] == "t1"  # readers see nothing of the lost attempt
    want = {"added": 1, "updated": 1, "skipped": 0}
    assert apply_changes(base, changes, EMBEDDER, tag="batch-1") == want
    assert apply_changes(base, changes, EMBEDDER, tag="batch-1") == want and len(calls) == 2
    assert [v.committed for v in store.versions(spark, base)] == [True, False, True]
    vacuum(spark, base)
    assert [v.committed for v in store.versions(spark, base)] == [True, True]


def test_of_two_attempts_the_first_committed_wins(spark, base, monkeypatch):
    rows = build_index(feed(spark, ("1", "mine", 1)), EMBEDDER)
    other = build_index(feed(spark, ("1", "other", 1)), EMBEDDER)
    real = store._write

    def overtaken(df, base_path, kind, number, tag):
        done = real(df, base_path, kind, number, tag)
        monkeypatch.setattr(store, "_write", real)
        publish_delta(other, base, "same")
        return done

    monkeypatch.setattr(store, "_write", overtaken)
    assert publish_delta(rows, base, "same") == 3  # the number of the winner
    assert titles(spark, base)["1"] == "other" and len(store.versions(spark, base)) == 2


def test_a_second_writer_makes_the_first_start_anew(spark, base, monkeypatch):
    real, made = streaming.refresh_delta, []

    def overtaken(*args, **kwargs):
        made.append(1)
        out = real(*args, **kwargs)
        if len(made) == 1:
            apply_changes(base, feed(spark, ("1", "newer", 9)), EMBEDDER)
        return out

    monkeypatch.setattr(streaming, "refresh_delta", overtaken)
    stats = apply_changes(base, feed(spark, ("1", "older", 5), ("2", "two", 5)), EMBEDDER)
    assert stats == {"added": 0, "updated": 1, "skipped": 1} and len(made) == 3
    assert titles(spark, base)["1"] == "newer"  # a stale change does not win by being committed late
    with pytest.raises(StaleWrite):
        publish_delta(build_index(feed(spark, ("3", "x", 1)), EMBEDDER), base, after=1)


def test_lengths_of_vectors_are_checked_when_written(spark, base):
    odd = build_index(feed(spark, ("1", "odd", 1)), HashEmbedder(9))
    for write in (publish_delta, lambda df, path: publish_index(df.unionByName(load_index(spark, base)), path)):
        with pytest.raises(ValueError, match="dimension mismatch"):
            write(odd, base)
    with pytest.raises(ValueError, match="dimension mismatch"):
        apply_changes(base, feed(spark, ("1", "odd", 1)), HashEmbedder(9))
    assert len(store.versions(spark, base)) == 1 and titles(spark, base)["1"] == "t1"


def test_known_lengths_need_no_scan(spark, base):
    index = load_index(spark, base).withColumn("embedding", F.raise_error(F.lit("scanned")).cast("array<float>"))
    delta = refresh_delta(index, feed(spark, ("1", "new", 1)), EMBEDDER, dimensions=read_state(spark, base).dimensions)
    assert delta.count() == 1


def test_an_empty_index_and_old_versions(spark, tmp_path, base):
    path = str(tmp_path / "empty")
    publish_index(build_index(feed(spark, ("1", "x", 1)).limit(0), EMBEDDER), path)
    assert read_state(spark, path).dimensions is None and load_index(spark, path).count() == 0
    assert apply_changes(path, feed(spark, ("1", "x", 1)), EMBEDDER)["added"] == 1
    with pytest.raises(FileNotFoundError):
        publish_delta(load_index(spark, base), str(tmp_path / "nothing"))
    for n in range(4):
        publish_delta(load_index(spark, base, 1).limit(1), base)
    vacuum(spark, base, keep=2)
    assert [v.number for v in store.versions(spark, base)] == [4, 5] and load_index(spark, base).count() == 40


RECORDS = "WorkItemId string, Title string, SemanticText string, Tags string, link string"


def test_refresh_from_a_snapshot(spark, tmp_path):
    from recordlens.plans.refresh import bucketed_diff, snapshot_diff
    from recordlens.streaming.refresh import refresh_from_snapshot

    path = str(tmp_path / "index")
    old = [(str(i), f"t{i}", f"body {i}", "tag", f"l{i}") for i in range(200)]
    publish_index(build_index(spark.createDataFrame(old, RECORDS), EMBEDDER), path)
    new = [("3", "t3", "other", "tag", "l3"), ("3.0", "t3", "body 3", "tag", "l3"), ("n1", "new", None, None, "x"), (None, "a", "b", "c", "d"),
           ("7", "t7", "changed", "tag9", None), *old[10:190]]
    snapshot = spark.createDataFrame(new, RECORDS)
    index = load_index(spark, path)
    for buckets in (1, 16, 4096):
        diff = bucketed_diff(index, snapshot, buckets=buckets)
        assert sorted(map(tuple, diff.collect())) == sorted(map(tuple, snapshot_diff(index, snapshot).collect()))
    stats = refresh_from_snapshot(spark, path, snapshot, EMBEDDER, tag="s")
    assert stats["new"] == 1 and stats["modified"] in (1, 2) and sum(stats.values()) == 183
    rows = {r.work_item_id: r for r in load_index(spark, path).collect()}
    assert len(rows) == 201 and rows["n1"].semantic_text == "new"
    assert (rows["7"].semantic_text, rows["7"].tags, rows["7"].link) == ("changed", "tag9", None)
    assert rows["199"].title == "t199" and rows["7"].embedding == EMBEDDER.embed(
        spark.createDataFrame([("t7 tag9 changed",)], "q string"), "q").first().embedding
    again = refresh_from_snapshot(spark, path, snapshot, EMBEDDER)
    assert again["new"] == again["modified"] == 0 and refresh_from_snapshot(spark, path, snapshot, EMBEDDER, tag="s") == stats
    assert len(store.versions(spark, path)) == 2
    slim = spark.createDataFrame([("7", "t7", "again")], "WorkItemId string, Title string, SemanticText string")
    refresh_from_snapshot(spark, path, slim, EMBEDDER)
    assert {r.tags for r in load_index(spark, path).where("work_item_id = '7'").collect()} == {"tag9"}
