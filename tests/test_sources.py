"""Record tables, side files, workbooks, repair and diagnostics."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from recordlens.embedders import HashEmbedder
from recordlens.plans.build import build_index
from recordlens.plans.diagnostics import diagnostics, index_stats
from recordlens.plans.repair import augment_links, repair_urls
from recordlens.sources.records import (
    export_csv,
    export_fingerprint_object,
    export_fingerprints,
    high_water_mark,
    incremental_pull,
    load_fingerprints,
    load_refresh_state,
    scan_metadata,
    scan_records,
)
from recordlens.sources.workbook import cells, read_workbooks, sheet_records, workbook_links
from workload.inputs import workbook_bytes

EMBEDDER = HashEmbedder(8)


def test_csv_round_trip(spark, tmp_path):
    rows = [("007", ' quoted "x", y ', "a\nb"), ("8", None, "z"), ("9", "ü", None)]
    df = spark.createDataFrame(rows, "WorkItemId string, Title string, SemanticText string")
    export_csv(df, str(tmp_path / "csv"))
    back = scan_records(spark, str(tmp_path / "csv"), "csv")
    got = sorted((r.work_item_id, r.title, r.semantic_text) for r in back.collect())
    assert got == sorted(rows)
    ids = {r.work_item_id for r in scan_metadata(spark, str(tmp_path / "csv")).collect()}
    assert ids == {"007", "8", "9"}


def test_parquet_scan_needs_the_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="Title"):
        scan_records(spark, str(tmp_path / "p"))


def test_fingerprint_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({" 1 ": " ab ", "2": "cd"}, indent=2))
    (tmp_path / "list.json").write_text("[1, 2]")
    (tmp_path / "broken.json").write_text("{")
    got = {r.work_item_id: r.fingerprint for r in load_fingerprints(spark, str(tmp_path), whole_files=True).collect()}
    assert got == {"1": "ab", "2": "cd"}


def test_indented_fingerprints_are_read_by_default(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({" 1 ": " ab ", "2": "c,d", 'q"': "{"}, indent=2, sort_keys=True))
    (tmp_path / "lines.json").write_text('{"3": "ef", "4": "gh"}\n\n{}\n{"5": "ij"}\n')
    got = {r.work_item_id: r.fingerprint for r in load_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {"1": "ab", "2": "c,d", 'q"': "{", "3": "ef", "4": "gh", "5": "ij"}
    for text in ('{"1":\n"ab"}', '{"1": "ab",\n"2": "cd"}', "[1, 2]"):
        (tmp_path / "other.json").write_text(text)
        with pytest.raises(Exception, match="whole_files=True"):
            load_fingerprints(spark, str(tmp_path / "other.json")).collect()


def test_fingerprint_export(spark, tmp_path):
    df = spark.range(50).select(
        F.col("id").cast("string").alias("work_item_id"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint")
    )
    export_fingerprint_object(df, str(tmp_path / "one"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "one")).collect()]
    assert list(json.loads(line)) == sorted(map(str, range(50)))
    export_fingerprints(df, str(tmp_path / "many"))
    assert spark.read.text(str(tmp_path / "many")).count() == 50
    with pytest.raises(ValueError, match="do not fit"):
        export_fingerprint_object(df, str(tmp_path / "none"), most=49)
    for name in ("one", "many"):
        back = load_fingerprints(spark, str(tmp_path / name))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    "text, ok",
    [
        ('{"last_refresh_time": "2024-01-01T00:00:00Z"}', True),
        ('{"last_refresh_time": "2024-01-01T00:00:00+02:00"}', True),
        ('{"last_refresh_time": " "}', False),
        ('{"last_refresh_time": "garbage"}', False),
        ("[]", False),
        ("{", False),
    ],
)
def test_refresh_state(spark, tmp_path, text, ok):
    (tmp_path / "state.json").write_text(text)
    row = load_refresh_state(spark, str(tmp_path / "state.json")).first()
    assert (row.refreshed_at is not None) == ok


def test_incremental_pull_is_strict_and_pushed_down(spark, tmp_path):
    path = str(tmp_path / "feed")
    df = spark.range(10).select("id", F.timestamp_seconds("id").alias("changed_at"))
    df.write.parquet(path)
    rows = spark.read.parquet(path)
    pulled = incremental_pull(rows, F.timestamp_seconds(F.lit(4)))
    assert sorted(r.id for r in pulled.collect()) == [5, 6, 7, 8, 9]
    assert "GreaterThan(changed_at" in pulled._jdf.queryExecution().executedPlan().toString()
    assert high_water_mark(rows).first()[0].second == 9


def book(sheet, strings=(), targets=()):
    """Workbook bytes around hand-written sheet XML."""
    data = workbook_bytes([])
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    new = {
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}" xmlns:r="{rel}">{sheet}</worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">'
        + "".join(f"<si><r><t>{s}</t></r></si>" for s in strings) + "</sst>",
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{package}">'
        + "".join(f'<Relationship Id="{i}" Type="{t}" Target="{x}"/>' for i, t, x in targets)
        + "</Relationships>",
    }
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as made:
        for name in old.namelist():
            made.writestr(name, new.get(name, old.read(name)))
    return out.getvalue()


def inline(ref, text):
    return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'


HEADER = f'<row r="1">{inline("A1", "WorkItemId")}{inline("C1", "Link")}</row>'


def links_of(spark, *books):
    df = spark.createDataFrame([(f"b{i}", b) for i, b in enumerate(books)], "path string, content binary")
    return {r.work_item_id: r.link for r in workbook_links(df).collect()}


def test_workbook_links(spark):
    sheet = (
        "<sheetData>" + HEADER
        + '<row r="2"><c r="A2"><v>1.0</v></c><c r="B2"><v>b2</v></c>'
        '<c r="C2"><f t="shared" si="3">HYPERLINK("http://h/"&amp;B2,"x")</f><v>0</v></c></row>'
        '<row r="3"><c r="A3"><v>2</v></c><c r="B3"><v>b3</v></c><c r="C3"><f t="shared" si="3"/><v>0</v></c></row>'
        '<row r="4"><c r="A4"><v>3</v></c><c r="B4"><v>0</v></c><c r="C4"><f t="shared" si="3"/></c></row>'
        '<row r="5"><c r="A5"><v>4</v></c><c r="C5" t="s"><v>0</v></c></row>'
        '<row r="6"><c r="A6"><v>5</v></c><c r="C6" t="s"><v>99</v></c></row>'
        '<row r="7"><c r="A7"><v>6</v></c><c r="C7"><v>0</v></c></row>'
        '<row r="8"><c r="A8"><v>7</v></c><c r="C8"><f>SUM(1)</f><v>http://raw</v></c></row>'
        f'<row r="9">{inline("A9", "x1")}{inline("C9", "http://bad-id")}</row>'
        '<row r="10"><c r="A10"><v>4</v></c><c r="C10" t="s"><v>1</v></c></row>'
        '</sheetData><hyperlinks><hyperlink ref="C8" r:id="k1"/><hyperlink ref="C7" r:id="k2"/></hyperlinks>'
    )
    targets = [("k1", "http://x/hyperlink", " http://target "), ("k2", "http://x/other", "http://no")]
    got = links_of(spark, book(sheet, ("http://first", "http://last"), targets))
    assert got == {
        1: "http://h/b2", 2: "http://h/b3", 3: "http://h/3", 4: "http://last", 7: "http://target",
    }


def test_broken_workbooks_give_nothing(spark):
    good = book(f'<sheetData>{HEADER}<row r="2"><c r="A2"><v>1</v></c>{inline("C2", "u")}</row></sheetData>')
    cut = book("<sheetData><row r='1'>").replace(b"x", b"x")
    no_header = book(f'<sheetData><row r="1">{inline("A1", "Other")}</row></sheetData>')
    assert links_of(spark, b"no zip", cut, no_header, good[: len(good) // 2], good) == {1: "u"}


def test_header_without_number_and_repeated_columns(spark):
    sheet = (
        f'<sheetData><row r="4">{inline("A4", "WorkItemId")}{inline("B4", "link")}{inline("C4", "Link")}</row>'
        f'<row r="5"><c r="A5"><v>8</v></c>{inline("B5", "no")}{inline("C5", "yes")}</row></sheetData>'
    )
    assert links_of(spark, book(sheet)) == {8: "yes"}


def test_workbook_files_as_records(spark, tmp_path):
    sheet = (
        f'<sheetData><row r="1">{inline("A1", "WorkItemId")}{inline("B1", "Title")}{inline("D1", "SemanticText")}</row>'
        f'<row r="2"><c r="A2"><v>5</v></c>{inline("B2", "t")}{inline("D2", "s")}</row>'
        f'<row r="3"><c r="A3"><v>6</v></c>{inline("B3", "u")}</row></sheetData>'
    )
    (tmp_path / "a.xlsx").write_bytes(book(sheet))
    got = scan_records(spark, str(tmp_path), "xlsx").collect()
    assert sorted((r.work_item_id, r.title, r.semantic_text) for r in got) == [
        ("5", "t", "s"), ("6", "u", None),
    ]
    assert cells(read_workbooks(spark, str(tmp_path))).count() == 8
    assert sheet_records(read_workbooks(spark, str(tmp_path))).columns == ["WorkItemId", "Title", "SemanticText"]


def test_augment_links_only_without_own_links(spark):
    links = spark.createDataFrame([(1, "u1"), (2, "nan")], "work_item_id bigint, link string")
    none = spark.createDataFrame([("1", "0"), ("2.0", None), ("x", "nan"), ("1.5", "")], "work_item_id string, link string")
    assert {r.work_item_id: r.link for r in augment_links(none, links).collect()} == {
        "1": "u1", "2.0": "", "x": "", "1.5": "",
    }
    some = spark.createDataFrame([("1", "own"), ("2", "0")], "work_item_id string, link string")
    assert {r.work_item_id: r.link for r in augment_links(some, links).collect()} == {"1": "own", "2": ""}


def test_repair(spark):
    rows = [("1.0", None), ("2", " "), ("3", "u"), (None, None)]
    df = spark.createDataFrame(rows, "BugID string, BugUrl string")
    fixed, count = repair_urls(df, "http://b/")
    assert [r.bug_url for r in fixed.orderBy(F.asc_nulls_last("work_item_id")).collect()] == [
        "http://b/1", "http://b/2", "u", "",
    ]
    assert count.first().repaired == 2
    without = spark.createDataFrame([("1",)], "WorkItemId string")
    assert repair_urls(without, "b/")[0].first().bug_url == "b/1"
    with pytest.raises(ValueError):
        repair_urls(spark.range(1), "b/")


def test_diagnostics(spark):
    records = spark.createDataFrame([("1", "disk", "disk", "u")], "WorkItemId string, Title string, SemanticText string, BugUrl string")
    index = build_index(records, EMBEDDER)
    state = spark.createDataFrame([("t", None)], "last_refresh_time string, refreshed_at timestamp")
    good = state.withColumn("refreshed_at", F.current_timestamp())
    report = diagnostics(records, index, good, index, embedder=EMBEDDER).collect()
    assert len(report) == 6 and all(r.ok and r.overall_ok for r in report)
    bad = diagnostics(records.drop("BugUrl"), index.limit(0), state.limit(0), index.limit(0), embedder=EMBEDDER)
    assert {r.name: r.ok for r in bad.collect()} == {
        "Metadata loaded + schema valid": False,
        "Embeddings loaded": True,
        "Row alignment": False,
        "Embeddings have unit length": True,
        "Refresh state readable": False,
        "Sample semantic search": False,
    }


def test_index_stats(spark):
    index = spark.createDataFrame([("1", None)], "work_item_id string, changed_at timestamp")
    assert index_stats(index).first().asDict() == {"total_indexed": 1, "last_indexed": "—"}
