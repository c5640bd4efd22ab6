"""Record tables, legacy side files and the incremental pull."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordlens.functions.text import filled, strip
from recordlens.schema import REQUIRED_RECORD, canonical

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def scan_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Record table in canonical columns; CSV cells are all read as text."""
    if fmt == "csv":
        raw = spark.read.options(**_CSV).csv(path)
    elif fmt == "xlsx":
        from recordlens.sources.workbook import read_workbooks, sheet_records

        raw = sheet_records(read_workbooks(spark, path))
    else:
        raw = spark.read.format(fmt).load(path)
    return canonical(raw, REQUIRED_RECORD)


def scan_text_table(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """CSV with a header under its own column names, every cell as text.

    ``multi_line=False`` says that no cell holds a line break: then large files are split among the tasks, else a file is one.
    """
    return spark.read.options(**{**_CSV, "multiLine": multi_line}).csv(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan whose few splits would leave most cores idle; else return it as is.

    Only for plain scans: their number of splits is known without running anything.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted, key) if scan.rdd.getNumPartitions() < wanted else scan


def scan_metadata(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Metadata CSV, every cell as text, so ids keep their spelling; empty cells are NULL."""
    return canonical(scan_text_table(spark, path, multi_line=multi_line), ("work_item_id",))


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV whose cells come back unchanged through :func:`scan_metadata`."""
    writer = df.write.option("header", True).option("quote", '"').option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).mode(mode).csv(path)


def parse_fingerprint_map(df: DataFrame, json: Column, *keep: str) -> DataFrame:
    """Entries of JSON id-to-hash objects; a corrupt or non-object text gives no rows."""
    return _fingerprints(df, F.from_json(json, "map<string,string>"), *keep)


def _fingerprints(df: DataFrame, entries: Column, *keep: str) -> DataFrame:
    parsed = df.select(*keep, F.explode(entries).alias("_k", "_v"))
    return parsed.select(
        *keep, strip("_k").alias("work_item_id"), filled(F.col("_v")).alias("fingerprint")
    )


def load_fingerprints(spark: SparkSession, path: str, *, whole_files: bool = False) -> DataFrame:
    """Fingerprint side file(s), read line by line: a JSON object per line, or one indented object with an entry per line.

    Any other line is an error. ``whole_files`` reads files that spread one object over lines in another way; each is then
    one row, so it is for files of bounded size, and a corrupt one gives no rows.
    """
    lines = spark.read.text(path, wholetext=whole_files).select("value")
    if whole_files:
        return parse_fingerprint_map(lines, F.col("value"))
    line = strip("value")
    entry = F.concat(F.lit("{"), F.regexp_replace(line, ",$", ""), F.lit("}"))
    parsed = F.from_json(F.when(line.startswith("{"), line).otherwise(entry), "map<string,string>")
    wrong = F.raise_error(F.concat(F.lit("no fingerprints in this line; try whole_files=True: "), F.left(line, F.lit(80))))
    return _fingerprints(
        lines.where(~line.isin("", "{", "}")), F.coalesce(parsed, wrong.cast("map<string,string>"))
    )


def export_fingerprints(fingerprints: DataFrame, path: str) -> None:
    """Write ``(work_item_id, fingerprint)`` as one JSON object per line, one entry each, at any size."""
    rows = fingerprints.where((F.col("work_item_id") != "") & (F.col("fingerprint") != ""))
    entry = F.create_map("work_item_id", "fingerprint")
    rows.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)


def export_fingerprint_object(fingerprints: DataFrame, path: str, most: int = 100_000) -> None:
    """Write all entries as the single JSON object that older readers expect, keys sorted.

    One task writes it, so a map of over ``most`` entries is an error.
    """
    rows = fingerprints.where((F.col("work_item_id") != "") & (F.col("fingerprint") != ""))
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} fingerprints do not fit a single object; use export_fingerprints")
    entries = F.sort_array(F.collect_list(F.struct("work_item_id", "fingerprint")))
    rows.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode("overwrite").text(path)


def parse_refresh_state(df: DataFrame, json: Column) -> DataFrame:
    """State text and its timestamp; NULL timestamp when blank, corrupt or not a time."""
    stamp = F.nullif(strip(F.get_json_object(json, "$.last_refresh_time")), F.lit(""))
    return df.select(
        stamp.alias("last_refresh_time"), F.try_to_timestamp(stamp).alias("refreshed_at")
    )


def load_refresh_state(spark: SparkSession, path: str) -> DataFrame:
    return parse_refresh_state(spark.read.text(path, wholetext=True), F.col("value"))


def incremental_pull(changes: DataFrame, since, column: str = "changed_at") -> DataFrame:
    """Rows changed strictly after ``since``; the comparison reaches the file scan."""
    return changes.where(F.col(column) > F.lit(since))


def high_water_mark(index: DataFrame) -> DataFrame:
    return index.agg(F.max("changed_at").alias("last_refresh_time"))

