"""Books broken in one of their parts, shared formulas that start anew, as-of values over ranges."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from recordlens.operators.ordering import last_before
from recordlens.sources.workbook import resolve_shared, workbook_links, workbook_parts
from workload.inputs import workbook_bytes


def broken(part, change):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook_bytes([(9, "en", "http://broken"), (10, "fr", "http://other")]))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, change(old.read(name)) if name == part else old.read(name))
    return out.getvalue()


@pytest.mark.parametrize(
    "part", ["xl/worksheets/sheet1.xml", "xl/sharedStrings.xml", "xl/worksheets/_rels/sheet1.xml.rels", "xl/workbook.xml"]
)
def test_a_book_broken_in_any_part_gives_nothing(spark, part):
    good = workbook_bytes([(1, "en", "http://one"), (2, "fr", "http://two"), (3, "de", None)])
    books = [("good", good), ("cut", broken(part, lambda xml: xml[:-20])), ("swapped", broken(part, lambda xml: xml + b"<a>"))]
    df = spark.createDataFrame(books, "path string, content binary")
    assert {r.path for r in workbook_parts(df).select("path").distinct().collect()} == {"good"}
    found = {r.work_item_id: r.link for r in workbook_links(df).collect()}
    assert found == {1: "http://one", 2: "http://two", 3: "https://tracker.example/edit/3"}


def test_the_latest_formula_before_a_row_is_shared(spark):
    rows = [
        ("b", 0, 2, "", "0"), ("b", 1, 3, "A3&1", "0"), ("b", 2, 4, "", "0"), ("b", 3, 5, "A5&2", "0"), ("b", 4, 6, "", "0"),
        ("b", 5, 7, "", "1"), ("b", 6, 8, "own", None), ("b", 7, 9, "", None), ("c", 0, 2, "", "0"),
    ]
    df = spark.createDataFrame(rows, "path string, row_order long, row long, formula string, shared string")
    got = {(r.path, r.row_order): r.formula for r in resolve_shared(df).collect()}
    assert got == {
        ("b", 0): "", ("b", 1): "A3&1", ("b", 2): "A4&1", ("b", 3): "A5&2", ("b", 4): "A6&2", ("b", 5): "", ("b", 6): "own",
        ("b", 7): "", ("c", 0): "",
    }


def test_last_value_before_in_a_hot_group(spark, tmp_path):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.choice([None] * 30 + [f"v{i}"])) for i in range(5000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "g string, at long, v string").write.parquet(path)
    found = last_before(spark.read.parquet(path), ["g"], "at", "v")
    want, last = [], {}
    for g, at, v in rows:
        want.append((g, at, last.get(g)))
        last[g] = v or last.get(g)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.columns == ["g", "at", "v"] and last_before(spark.read.parquet(path).limit(0), ["g"], "at", "v").count() == 0
    assert spark.read.parquet(path).groupBy("g").agg(F.max("at")).count() == 4
