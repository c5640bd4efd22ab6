"""The given tables as the inputs the engine expects."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordlens.sources.records import spread

EDIT_URL = "https://tracker.example/edit/"
CUT = "2024-01-15 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def first_line(text):
    return F.split_part(text, F.lit("\n"), F.lit(1))


def as_records(docs: DataFrame, *extra) -> DataFrame:
    """Documents under record headers: title is the first line, the language is the tag."""
    return docs.select(
        F.col("doc_id").alias("WorkItemId"),
        first_line(F.col("text")).alias("Title"),
        F.col("text").alias("SemanticText"),
        F.col("lang").alias("Tags"),
        F.col("source").alias("link"),
        *extra,
    )


def records(spark, folder) -> DataFrame:
    return as_records(documents(spark, folder))


def linked_records(spark, folder) -> DataFrame:
    """Records with the URL of the page of the same number, missing for most."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url")
    joined = documents(spark, folder).join(pages, "doc_id", "left")
    return as_records(joined, F.col("url").alias("BugUrl"))


def vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("work_item_id"), "embedding"
    )


def revised_records(spark, folder) -> DataFrame:
    """A later snapshot: labelled documents carry their label, and pages are new records."""
    labels = table(spark, folder, "labels")
    docs = documents(spark, folder).join(labels, "doc_id", "left")
    note = F.concat(F.lit("\nquality "), F.col("quality").cast("string"))
    revised = as_records(
        docs.withColumn("text", F.concat("text", F.coalesce(note, F.lit(""))))
    ).withColumn("WorkItemId", F.col("WorkItemId").cast("string"))
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id")).alias("WorkItemId"),
        F.col("url").alias("Title"),
        F.col("html").alias("SemanticText"),
    )
    return revised.unionByName(pages, allowMissingColumns=True)


def as_changes(events: DataFrame) -> DataFrame:
    """Events as a change feed: one record per user, its state is the last event."""
    return events.select(
        F.col("user_id").alias("BugID"),
        F.col("event_type").alias("Title"),
        F.col("props").alias("SemanticText"),
        F.col("ts").cast("timestamp").alias("changed_at"),
        F.col("event_id").alias("seq"),
    )


def changes(spark, folder) -> DataFrame:
    return as_changes(table(spark, folder, "events"))


def changes_until(spark, folder) -> DataFrame:
    return changes(spark, folder).where(F.col("changed_at") <= F.lit(CUT).cast("timestamp"))


def changes_since(spark, folder) -> DataFrame:
    return changes(spark, folder).where(F.col("changed_at") > F.lit(CUT).cast("timestamp"))


def query_table(spark, folder) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")
    )


def workbooks(spark, folder) -> DataFrame:
    """Workbooks ``(path, content)`` with the ids and links of all documents.

    Each language stores its links in another way: hyperlink relation, shared text, inline text;
    documents without a page have a formula or depend on a shared formula.
    """
    source = linked_records(spark, folder).select(
        F.col("WorkItemId"), F.col("Tags"), F.col("BugUrl")
    )
    return source.mapInArrow(_pack, "path string, content binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = batch.to_pylist()
            content = workbook_bytes(
                [(r["WorkItemId"], r["Tags"], r["BugUrl"]) for r in rows]
            )
            yield pa.RecordBatch.from_pydict(
                {"path": [f"book-{rows[0]['WorkItemId']}.xlsx"], "content": [content]}
            )


def workbook_bytes(rows: list[tuple]) -> bytes:
    """A minimal workbook of ``(id, language, url)`` rows with the headers WorkItemId and link."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    strings, relations, anchors, shared_base = ["WorkItemId", "link"], [], [], False
    lines = ['<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>']
    for n, (record, language, url) in enumerate(rows, start=2):
        own = f'<c r="A{n}"><v>{record}</v></c>'
        formula = escape(f'HYPERLINK("{EDIT_URL}"&A{n},"open")')
        if url is None and language == "en":
            cell = f'<c r="B{n}"><f>{formula}</f><v>0</v></c>'
        elif url is None:
            text = "" if shared_base else formula
            shared_base = True
            cell = f'<c r="B{n}"><f t="shared" si="0">{text}</f><v>0</v></c>'
        elif language == "en":
            relations.append(
                f'<Relationship Id="h{n}" Type="{rel}/hyperlink" Target={quoteattr(url)}/>'
            )
            anchors.append(f'<hyperlink ref="B{n}" r:id="h{n}"/>')
            cell = f'<c r="B{n}"><v>0</v></c>'
        elif language == "fr":
            strings.append(url)
            cell = f'<c r="B{n}" t="s"><v>{len(strings) - 1}</v></c>'
        else:
            cell = f'<c r="B{n}" t="inlineStr"><is><t>{escape(url)}</t></is></c>'
        lines.append(f'<row r="{n}">{own}{cell}</row>')
    links = f"<hyperlinks>{''.join(anchors)}</hyperlinks>" if anchors else ""
    items = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
        '<sheet name="records" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}"><Relationship Id="r1" '
        f'Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">{items}</sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}" xmlns:r="{rel}"><sheetData>'
        f"{''.join(lines)}</sheetData>{links}</worksheet>",
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{package}">'
        f"{''.join(relations)}</Relationships>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return buffer.getvalue()
