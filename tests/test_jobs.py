"""Jobs from file to file: URL repair, links from workbooks, pull from the newest known change."""

import os
from datetime import datetime

import pytest

import recordlens as rl
from recordlens.sources.records import scan_text_table
from workload.inputs import EDIT_URL, workbook_bytes

EMBEDDER = rl.HashEmbedder(16)


def csv(folder, name, text):
    path = folder / name
    path.mkdir()
    (path / "part.csv").write_text(text, encoding="utf-8")
    return str(path)


def cells(spark, path):
    return sorted((tuple(r) for r in scan_text_table(spark, path).collect()), key=repr)


def test_url_repair_keeps_other_cells_and_columns(spark, tmp_path):
    text = 'Note,WorkItemId,BugUrl,_missing\n"a, ""b""\nc",007.0,,x\n,8,https://own/8, y \n,,,\nz,abc,  ,\n'
    source, target = csv(tmp_path, "in", text), str(tmp_path / "out")
    assert rl.repair_url_file(spark, source, target, EDIT_URL) == 2
    before, after = scan_text_table(spark, source), scan_text_table(spark, target)
    assert after.columns == before.columns == ["Note", "WorkItemId", "BugUrl", "_missing"]
    assert [(r[0], r[1], r[3]) for r in cells(spark, target)] == [(r[0], r[1], r[3]) for r in cells(spark, source)]
    urls = {r.WorkItemId: r.BugUrl for r in after.collect()}
    assert urls == {"007.0": EDIT_URL + "007", "8": "https://own/8", None: None, "abc": EDIT_URL + "abc"}


def test_url_repair_adds_the_column_and_writes_nothing_for_0(spark, tmp_path):
    source, target = csv(tmp_path, "in", "BugID,Title\n1,a\n2,b\n"), str(tmp_path / "out")
    assert rl.repair_url_file(spark, source, target, EDIT_URL, multi_line=False) == 2
    assert cells(spark, target) == [("1", "a", EDIT_URL + "1"), ("2", "b", EDIT_URL + "2")]
    again = str(tmp_path / "again")
    assert rl.repair_url_file(spark, target, again, EDIT_URL) == 0 and not os.path.exists(again)
    with pytest.raises(Exception, match="(?i)exists"):
        rl.repair_url_file(spark, source, target, EDIT_URL)
    assert len(cells(spark, target)) == 2
    with pytest.raises(ValueError, match="BugID"):
        rl.repair_url_file(spark, csv(tmp_path, "other", "Title\na\n"), again, EDIT_URL)


def test_links_from_workbooks_and_a_broken_one(spark):
    books = [
        ("good.xlsx", workbook_bytes([(1, "en", "https://one"), (2, "fr", "https://two"), (3, "de", None)])),
        ("broken.xlsx", workbook_bytes([(4, "en", "https://four")])[:-40]),
    ]
    books = spark.createDataFrame([(p, bytearray(c)) for p, c in books], "path string, content binary")
    schema = "WorkItemId string, Title string, link string"
    rows = [("1", "a", None), ("2.0", "b", "0"), ("3", "c", " "), ("4", "d", "nan"), (None, "e", None), ("x", "f", None)]
    out = rl.augment_links_from_workbooks(spark.createDataFrame(rows, schema), books)
    links = {r.title: r.link for r in out.collect()}
    assert links == {"a": "https://one", "b": "https://two", "c": EDIT_URL + "3", "d": "", "e": "", "f": ""}
    kept = rl.augment_links_from_workbooks(spark.createDataFrame([*rows, ("9", "g", "https://own")], schema), books)
    assert {r.title: r.link for r in kept.collect()} == {**dict.fromkeys("abcdef", ""), "g": "https://own"}


def test_pull_takes_the_newest_moment_again(spark, tmp_path):
    base = str(tmp_path / "index")
    schema = "BugID string, Title string, SemanticText string, changed_at timestamp"
    early, mark, late = (datetime(2024, 1, day) for day in (1, 2, 3))
    first = [("1", "one", "x", early), ("2", "two", "x", mark)]
    rl.publish_index(rl.build_index(spark.createDataFrame(first, schema), EMBEDDER), base)
    more = [*first, ("3", "same moment", "x", mark), ("1", "changed late", "x", late), ("4", "too early", "x", early)]
    feed = spark.createDataFrame(more, schema)
    assert rl.refresh_from_mark(base, feed, EMBEDDER) == {"added": 1, "updated": 1, "skipped": 1}
    titles = {r.work_item_id: r.title for r in rl.load_index(spark, base).collect()}
    assert titles == {"1": "changed late", "2": "two", "3": "same moment"}
    assert rl.refresh_from_mark(base, feed, EMBEDDER) == {"added": 0, "updated": 0, "skipped": 1}


def test_an_index_without_times_takes_the_whole_feed(spark, tmp_path):
    base = str(tmp_path / "index")
    rl.publish_index(rl.build_index(spark.createDataFrame([("1", "a", "b")], "BugID string, Title string, SemanticText string"), EMBEDDER), base)
    feed = spark.createDataFrame([("2", "n", "m", datetime(2024, 1, 1))], "BugID string, Title string, SemanticText string, changed_at timestamp")
    assert rl.refresh_from_mark(base, feed, EMBEDDER)["added"] == 1
