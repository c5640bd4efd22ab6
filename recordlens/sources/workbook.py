"""Spreadsheet workbooks (.xlsx) as tables of cells, and the record links in them.

Each workbook is one row of ``(path, content)``; tasks unzip it and stream its XML into rows of all kinds, in one pass. A
book's last row says that it was read to its end; rows of a book without it are not used, so one that is broken anywhere gives
nothing, and nothing is held back while it is read. Everything after that is joins and column expressions.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordlens.functions.links import (
    EMPTY_CELL_LINKS,
    complete_edit_url,
    concat_tokens,
    hyperlink_argument,
    is_literal,
    leading_column,
    literal_text,
    reference_column,
    shift_rows,
)
from recordlens.functions.text import strip, to_number
from recordlens.operators.ordering import last_before
from recordlens.session import materialize

# XML name spaces of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# Header cells of the id column and of the link column.
ID_HEADERS = ("WorkItemId",)
LINK_HEADERS = ("link", "Link")

_EMIT = 4096
_BROKEN = (
    zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, TypeError, EOFError
)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content")


# Kinds of rows of a workbook; each fills its own columns.
CELL, STRING, ANCHOR, TARGET, WHOLE = "cell", "string", "anchor", "target", "whole"
_COLUMNS = {
    "part": pa.string(), "row_order": pa.int64(), "place": pa.int32(), "row": pa.int64(), "row_label": pa.string(),
    "ref": pa.string(), "kind": pa.string(), "stored": pa.string(), "inline": pa.string(), "formula": pa.string(),
    "shared": pa.string(), "idx": pa.int64(), "text": pa.string(), "rid": pa.string(), "target": pa.string(),
}
_SQL = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int"}
_SCHEMA = "path string, " + ", ".join(f"`{n}` {_SQL[t]}" for n, t in _COLUMNS.items())
_FIELDS = {
    CELL: ("row_order", "place", "row", "row_label", "ref", "kind", "stored", "inline", "formula", "shared"),
    STRING: ("idx", "text"),
    ANCHOR: ("ref", "rid"),
    TARGET: ("rid", "target"),
    WHOLE: (),
}


def workbook_parts(workbooks: DataFrame, name: str = "parts") -> DataFrame:
    """All rows of all whole workbooks, written to the shared folder once; ``part`` tells their kind.

    A broken workbook leaves rows behind until it breaks, but not its last one, by which whole ones are told.
    """
    scanned = materialize(workbooks.mapInArrow(_scan, _SCHEMA), name)
    whole = scanned.where(F.col("part") == WHOLE).select("path")
    return scanned.where(F.col("part") != WHOLE).join(whole, "path", "left_semi")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    for part, rows in ((CELL, _cell_rows), (STRING, _string_rows), (ANCHOR, _anchor_rows), (TARGET, _target_rows)):
                        yield from _batches(path, part, rows(book))
                yield from _batches(path, WHOLE, iter([()]))
            except _BROKEN:
                continue


def _batches(path: str, part: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while chunk := list(islice(rows, _EMIT)):
        given = dict(zip(_FIELDS[part], zip(*chunk))) | {"part": [part] * len(chunk)}
        nothing = [None] * len(chunk)
        arrays = [pa.array(given.get(n, nothing), t) for n, t in _COLUMNS.items()]
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(chunk), pa.string()), *arrays], names=["path", *_COLUMNS])


def _of_kind(parts: DataFrame, part: str) -> DataFrame:
    return parts.where(F.col("part") == part).select("path", *_FIELDS[part])


def _relations(book: zipfile.ZipFile, name: str) -> list[dict]:
    return [r.attrib for r in ElementTree.fromstring(book.read(name)).iter(f"{PACKAGE}Relationship")]


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    first = next(sheets, None)
    if first is None:
        raise KeyError("workbook has no sheet")
    wanted = first.attrib[f"{REL}id"]
    targets = {r["Id"]: r["Target"] for r in _relations(book, "xl/_rels/workbook.xml.rels")}
    return "xl/" + targets[wanted].lstrip("/")


def _finished(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Complete elements in document order, freed once the caller is done with them."""
    with book.open(name) as stream:
        for _, element in ElementTree.iterparse(stream):
            if element.tag == tag:
                yield element
            if element.tag in (tag, f"{MAIN}row"):
                element.clear()


def _cell_rows(book: zipfile.ZipFile) -> Iterator[tuple]:
    for order, row in enumerate(_finished(book, _first_sheet(book), f"{MAIN}row")):
        label = row.attrib.get("r", "")
        number = int(label) if label.isdigit() else 0
        for place, cell in enumerate(row.iter(f"{MAIN}c")):
            ref = cell.attrib.get("r")
            if not ref:
                continue
            value, formula = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}f")
            inline = "".join(t.text or "" for t in cell.iterfind(f"{MAIN}is/{MAIN}t"))
            about = {} if formula is None else formula.attrib
            yield (
                order,
                place,
                number,
                label,
                ref,
                cell.attrib.get("t", ""),
                None if value is None else value.text or "",
                inline,
                "" if formula is None else (formula.text or "").strip(),
                about.get("si") if about.get("t") == "shared" else None,
            )


def _string_rows(book: zipfile.ZipFile) -> Iterator[tuple]:
    if "xl/sharedStrings.xml" in book.namelist():
        for i, item in enumerate(_finished(book, "xl/sharedStrings.xml", f"{MAIN}si")):
            yield i, "".join(t.text or "" for t in item.iter(f"{MAIN}t"))


def _target_rows(book: zipfile.ZipFile) -> Iterator[tuple]:
    folder, _, leaf = _first_sheet(book).rpartition("/")
    name = f"{folder}/_rels/{leaf}.rels"
    if name in book.namelist():
        for relation in _relations(book, name):
            if relation.get("Type", "").endswith("/hyperlink"):
                yield relation.get("Id", ""), relation.get("Target", "")


def _anchor_rows(book: zipfile.ZipFile) -> Iterator[tuple]:
    for anchor in _finished(book, _first_sheet(book), f"{MAIN}hyperlink"):
        if anchor.attrib.get("ref") and anchor.attrib.get(f"{REL}id"):
            yield anchor.attrib["ref"], anchor.attrib[f"{REL}id"]


def hyperlinks(parts: DataFrame) -> DataFrame:
    """Link target per cell reference."""
    joined = _of_kind(parts, ANCHOR).join(_of_kind(parts, TARGET), ["path", "rid"])
    return joined.select("path", "ref", "target")


def cells(workbooks: DataFrame) -> DataFrame:
    """Cells of the first sheets with their text."""
    return cells_of(workbook_parts(workbooks))


def cells_of(parts: DataFrame) -> DataFrame:
    """Cells with their text: shared strings are looked up, an unknown index gives empty text."""
    # Cells that need no string get numbers of their own, so no join key gathers them all.
    unique = -F.lit(1) - F.col("row_order") * F.lit(1 << 20) - F.col("place")
    index = F.when(F.col("kind") == "s", strip("stored").try_cast("bigint"))
    raw = _of_kind(parts, CELL).withColumn("idx", F.coalesce(index, unique))
    joined = raw.join(_of_kind(parts, STRING), ["path", "idx"], "left")
    value = (
        F.when((F.col("kind") == "s") & F.col("stored").isNotNull(), F.col("text"))
        .when(F.col("kind") == "inlineStr", F.col("inline"))
        .otherwise(F.col("stored"))
    )
    valued = joined.withColumns(
        {"value": F.coalesce(strip(value), F.lit("")), "col": leading_column(F.col("ref"))}
    )
    return valued.drop("idx", "text", "stored", "inline", "kind")


def header_cells(sheet: DataFrame) -> DataFrame:
    """Cells of the header row: the row numbered 1, else the first one."""
    first = sheet.groupBy("path").agg(
        F.min(
            F.struct((F.col("row_label") != "1").alias("other"), F.col("row_order"))
        ).alias("h")
    )
    head = first.select("path", F.col("h.row_order").alias("row_order"))
    return sheet.join(head, ["path", "row_order"])


def sheet_records(workbooks: DataFrame, headers=None) -> DataFrame:
    """First sheets as a record table: named columns from the header row, all text.

    Without ``headers`` the known record headers are looked for; absent ones are left out.
    """
    from recordlens.schema import HEADERS

    sheet = materialize(cells(workbooks), "cells")
    head = header_cells(sheet).select("path", "col", F.col("value").alias("name"))
    if headers is None:
        known = [h for names in HEADERS.values() for h in names]
        # At most one value per known header name.
        found = head.where(F.col("name").isin(known)).select("name").distinct().collect()
        headers = [h for h in known if h in {r.name for r in found}]
    named = sheet.where(F.col("row_label") != "1").join(head, ["path", "col"])
    named = named.where(F.col("name").isin(*headers))
    values = [
        F.max(F.when(F.col("name") == h, F.nullif("value", F.lit("")))).alias(h) for h in headers
    ]
    grouped = named.groupBy("path", "row_order").agg(*values)
    first = header_cells(sheet).select("path", "row_order").distinct()
    return grouped.join(first, ["path", "row_order"], "left_anti").select(*headers)


def resolve_shared(formulas: DataFrame) -> DataFrame:
    """Give dependents of a shared formula its text, moved from the base row to their own.

    ``formulas(path, row_order, row, formula, shared)``, stored; the last row before with the same ``shared`` that has text
    is the base, as a number may be used again further down.
    """
    base = F.when(
        F.col("shared").isNotNull() & (F.col("formula") != ""), F.struct("row", "formula")
    )
    # Rows without a shared formula get keys of their own, so they share no base.
    own = F.coalesce(F.col("shared"), F.concat(F.lit("row "), F.col("row_order")))
    keyed = formulas.withColumns({"_key": own, "_base": base})
    joined = last_before(keyed, ["path", "_key"], "row_order", "_base")
    usable = (F.col("formula") == "") & F.col("_base").isNotNull()
    moved = shift_rows(F.col("_base.formula"), F.col("_base.row"), F.col("row"))
    return joined.withColumn("formula", F.when(usable, moved).otherwise(F.col("formula"))).drop("_base", "_key")


def evaluate_hyperlinks(formulas: DataFrame, sheet: DataFrame) -> DataFrame:
    """URL of each HYPERLINK formula.

    ``formulas(path, row_order, formula, record_id)`` against ``sheet(path, row_order, col,
    value)``: references read the same row, whatever row they name; an empty or zero cell stands
    for the record id. Tokens that are neither text nor a reference are left out.
    """
    tokens = formulas.select(
        "path",
        "row_order",
        "record_id",
        F.posexplode(concat_tokens(hyperlink_argument(F.col("formula")))).alias("pos", "token"),
    ).withColumn("col", reference_column(F.col("token")))
    looked_up = tokens.join(
        sheet.select("path", "row_order", "col", "value"), ["path", "row_order", "col"], "left"
    )
    read = F.coalesce(F.col("value"), F.lit(""))
    part = (
        F.when(is_literal(F.col("token")), literal_text(F.col("token")))
        .when(F.col("col").isNull(), F.lit(""))
        .when(read.isin("", "0", "0.0"), F.col("record_id"))
        .otherwise(read)
    )
    # A formula has few tokens (its text is bounded by the format), so these groups stay small.
    parts = looked_up.groupBy("path", "row_order", "record_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts")
    )
    url = strip(F.array_join(F.transform("parts", lambda p: p["part"]), ""))
    return parts.select(
        "path", "row_order", complete_edit_url(url, F.col("record_id")).alias("url")
    )


def workbook_links(workbooks: DataFrame) -> DataFrame:
    """``(work_item_id bigint, link)`` of all workbooks; the last row of an id wins.

    A link comes from the cell's hyperlink, else its formula, else its text. The cells are
    written to the shared folder once, so that unzipping is not repeated by every join.
    """
    parts = workbook_parts(workbooks)
    sheet = materialize(cells_of(parts), "cells")
    head = header_cells(sheet)

    def column_of(names: tuple[str, ...]):
        return F.max_by("col", F.when(F.col("value").isin(*names), F.col("place")))

    columns = head.groupBy("path").agg(
        column_of(ID_HEADERS).alias("id_col"), column_of(LINK_HEADERS).alias("link_col")
    )
    placed = sheet.where(F.col("row_label") != "1").join(columns, "path")
    placed = placed.where(F.col("col").isin(F.col("id_col"), F.col("link_col")))

    def last_cell(column: str, value):
        return F.max_by(value, F.when(F.col("col") == F.col(column), F.col("place")))

    link_cell = F.struct("row", "ref", "value", "formula", "shared")
    rows = placed.groupBy("path", "row_order").agg(
        last_cell("id_col", to_number(F.col("value")).try_cast("bigint")).alias("work_item_id"),
        last_cell("link_col", link_cell).alias("c"),
    )
    rows = rows.select("path", "row_order", "work_item_id", "c.*").where(F.col("ref").isNotNull())
    # Formulas of rows without an id still count as the base of a shared one, so ids come after.
    resolved = resolve_shared(materialize(rows, "link-rows")).where(F.col("work_item_id").isNotNull())
    resolved = materialize(resolved, "link-cells")
    record_id = F.col("work_item_id").cast("string")
    urls = evaluate_hyperlinks(
        resolved.where(F.col("formula") != "").withColumn("record_id", record_id), sheet
    )
    joined = resolved.join(hyperlinks(parts), ["path", "ref"], "left").join(
        urls, ["path", "row_order"], "left"
    )
    from_cell = F.coalesce(F.nullif("url", F.lit("")), F.col("value"))
    link = F.when(F.col("target").isNotNull(), strip("target")).otherwise(from_cell)
    usable = joined.withColumn("link", link).where(
        (F.col("link") != "") & ~F.col("link").isin(*EMPTY_CELL_LINKS)
    )
    return usable.groupBy("work_item_id").agg(
        F.max_by("link", F.struct("path", "row_order")).alias("link")
    )
