"""Link upkeep: filling missing URLs, taking links from workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordlens.functions.links import clean_link, url_for_id
from recordlens.functions.text import normalize_id, strip, to_number
from recordlens.schema import HEADERS, canonical, require_columns
from recordlens.sources.records import export_csv, scan_text_table
from recordlens.sources.workbook import workbook_links


def repair_urls(df: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """Fill blank URLs from the id; also a one-row table with the number of repaired rows.

    With a count of 0 the table came back unchanged and need not be written.
    """
    rows = canonical(df, ("work_item_id",))
    missing = strip(F.coalesce(F.col("bug_url"), F.lit(""))) == ""
    built = url_for_id(normalize_id(F.col("work_item_id")), base_url)
    marked = rows.withColumn("_missing", missing)
    fixed = marked.withColumn("bug_url", F.when(F.col("_missing"), built).otherwise(F.col("bug_url")))
    repaired = F.col("_missing") & (strip("bug_url") != "")
    count = fixed.agg(F.count_if(F.coalesce(repaired, F.lit(False))).alias("repaired"))
    return fixed.drop("_missing"), count


def repair_url_file(spark: SparkSession, source: str, target: str, base_url: str, *, multi_line: bool = True) -> int:
    """Copy the CSV table ``source`` to the new folder ``target`` with missing BugUrl cells filled from the id.

    All other cells and columns stay as they are; without a column BugUrl one is added. Returns how many rows got a URL;
    with 0 nothing is written, so readers stay with ``source``. A target that exists is an error, never overwritten.
    """
    raw = scan_text_table(spark, source, multi_line=multi_line)
    require_columns(raw, ("work_item_id",))
    id_header = next(h for h in HEADERS["work_item_id"] if h in raw.columns)
    url_header = next((h for h in HEADERS["bug_url"] if h in raw.columns), "BugUrl")
    url = F.col(f"`{url_header}`") if url_header in raw.columns else F.lit(None).cast("string")
    missing = strip(F.coalesce(url, F.lit(""))) == ""
    built = F.coalesce(url_for_id(normalize_id(F.col(f"`{id_header}`")), base_url), F.lit(""))
    repaired = raw.agg(F.count_if(missing & (strip(built) != ""))).first()[0]
    if repaired:
        export_csv(raw.withColumn(url_header, F.when(missing, built).otherwise(url)), target, mode="error")
    return repaired


def augment_links_from_workbooks(records: DataFrame, workbooks: DataFrame) -> DataFrame:
    """Canonical records with the links of ``workbooks(path, content)``, by id.

    Workbooks are read only when no record has a link of its own; the search for one stops at the first. A workbook that
    breaks anywhere gives no links at all.
    """
    rows = canonical(records, ("work_item_id",))
    own = clean_link(F.col("link"))
    if rows.where(own != "").select("link").head(1):
        return rows.withColumn("link", own)
    return augment_links(rows, workbook_links(workbooks))


def augment_links(records: DataFrame, link_map: DataFrame) -> DataFrame:
    """Give records the links of ``link_map(work_item_id bigint, link)``.

    Only when no record has a link yet; otherwise the cleaned own links stay. The test is a
    scalar subquery, so it runs once and not per row.
    """
    own = clean_link(F.col("link"))
    any_link = records.select(F.coalesce(F.bool_or(own != ""), F.lit(False)).alias("b")).scalar()
    number = to_number(F.col("work_item_id"))
    key = F.when(number == F.floor(number), number.try_cast("bigint"))
    # Records without a number match nothing; a second key spreads them over the tasks.
    odd = F.when(key.isNull(), F.xxhash64("work_item_id").bitwiseOR(F.lit(1))).otherwise(0)
    keyed = records.withColumns({"_key": F.coalesce(key, F.lit(0)), "_odd": odd, "_own": own})
    found = link_map.select(
        F.col("work_item_id").alias("_key"),
        F.lit(0).cast("bigint").alias("_odd"),
        F.col("link").alias("_found"),
    )
    joined = keyed.join(found, ["_key", "_odd"], "left")
    link = F.when(any_link, F.col("_own")).otherwise(clean_link(F.col("_found")))
    return joined.withColumn("link", link).select(*records.columns)
