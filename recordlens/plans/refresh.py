"""Incremental refresh: what changed, embed only that, overlay it on the index."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from recordlens.functions.text import filled, fingerprint, fingerprint_undelimited, normalize_id
from recordlens.functions.text import strip
from recordlens.operators.cleaning import clean_records
from recordlens.operators.dedupe import dedupe_first, dedupe_last
from recordlens.operators.joins import small_side, spread_join
from recordlens.plans.build import check_dimension, record_text, with_fingerprint
from recordlens.schema import INDEX_COLUMNS, canonical, missing_columns
from recordlens.session import materialize
from recordlens.sources.store import overlay

NEW, MODIFIED, UNCHANGED, RENEWED = "new", "modified", "unchanged", "renewed"
UNKNOWN = (None, None)


class Refresh(NamedTuple):
    """``delta``: new and changed rows; ``stats``: one row of counts; ``index``: the result."""

    delta: DataFrame
    stats: DataFrame
    index: DataFrame


def latest_changes(
    changes: DataFrame, *, include_tags: bool = False, full_table: bool = False
) -> DataFrame:
    """Cleaned change feed, the last row per id, with fingerprints."""
    cleaned = clean_records(changes, drop_null_title=full_table)
    last = dedupe_last(cleaned, "work_item_id", "changed_at", "seq")
    return with_fingerprint(last, include_tags=include_tags)


def classify(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``current`` with a ``status`` against ``previous(work_item_id, fingerprint, …)``.

    Columns of ``previous`` come along with the prefix ``_old_``.
    """
    old = previous.withColumnsRenamed(
        {c: f"_old_{c}" for c in previous.columns if c != "work_item_id"}
    )
    joined = current.join(old, "work_item_id", "left")
    status = (
        F.when(F.col("_old_fingerprint").isNull(), NEW)
        .when(F.col("_old_fingerprint") != F.col("fingerprint"), MODIFIED)
        .otherwise(UNCHANGED)
    )
    return joined.withColumn("status", status)


def snapshot_diff(previous: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Status per id of a full snapshot against the stored fingerprints; nothing is deleted.

    Only ids and hashes are shuffled, not the texts.
    """
    hashed = with_fingerprint(clean_records(snapshot))
    slim = hashed.select("work_item_id", "fingerprint", "changed_at", "seq")
    current = dedupe_last(slim, "work_item_id", "changed_at", "seq")
    stored = previous.select("work_item_id", "fingerprint")
    return classify(current, stored).select("work_item_id", "fingerprint", "status")


def bucketed_diff(
    index: DataFrame, snapshot: DataFrame, *, include_tags: bool = False, buckets: int = 4096, folder: str | None = None
) -> DataFrame:
    """As :func:`snapshot_diff`, but ids are compared only in buckets that differ.

    Ids are dealt to buckets by hash. A bucket's digest is the sum of the hashes of its (id, fingerprint) pairs, taken with
    map-side combining on either side, with its number of rows; where both agree, all ids of the bucket are unchanged and
    stay where they are. The snapshot's ids and hashes are stored below ``folder`` first, so its texts are read once.
    """
    hashed = with_fingerprint(clean_records(snapshot), include_tags=include_tags)
    slim = hashed.select("work_item_id", "fingerprint", "changed_at", "seq")
    current = dedupe_last(slim, "work_item_id", "changed_at", "seq").select("work_item_id", "fingerprint")
    bucket = F.pmod(F.xxhash64("work_item_id"), F.lit(buckets)).cast("int")
    current = materialize(current.withColumn("bucket", bucket), "current", folder)
    stored = index.select("work_item_id", "fingerprint", "changed_at")
    # An index built from repeated records may hold an id twice: its first row stands for it.
    stored = dedupe_first(stored, "work_item_id", "changed_at").select("work_item_id", "fingerprint", bucket.alias("bucket"))
    stored = materialize(stored, "stored", folder)

    def digests(rows: DataFrame, side: str) -> DataFrame:
        pair = F.xxhash64("work_item_id", "fingerprint").cast("decimal(38,0)")
        return rows.groupBy("bucket").agg(F.sum(pair).alias(f"{side}_sum"), F.count("*").alias(f"{side}_n"))

    met = digests(current, "new").join(digests(stored, "old"), "bucket", "left")
    same = F.col("new_sum").eqNullSafe(F.col("old_sum")) & F.col("new_n").eqNullSafe(F.col("old_n"))
    # As many rows as buckets, at most.
    judged = F.broadcast(materialize(met.select("bucket", same.alias("same")), "buckets", folder))
    known = current.join(judged, "bucket")
    differing = known.where(~F.col("same")).drop("same", "bucket")
    old = stored.join(judged.where(~F.col("same")), "bucket", "left_semi").drop("bucket")
    changed = classify(differing, old).select("work_item_id", "fingerprint", "status")
    unchanged = known.where("same").select("work_item_id", "fingerprint", F.lit(UNCHANGED).alias("status"))
    return changed.unionByName(unchanged)


def snapshot_delta(
    index: DataFrame, snapshot: DataFrame, diff: DataFrame, embedder, *, include_tags: bool = False
) -> DataFrame:
    """New and changed index rows of a snapshot, by its stored difference; only these are embedded."""
    touched = diff.where(F.col("status") != UNCHANGED).select("work_item_id", "fingerprint")
    # By hash too, so that of several rows of an id the one that the difference is about is taken.
    hashed = with_fingerprint(clean_records(snapshot), include_tags=include_tags)
    meant = hashed.join(small_side(touched), ["work_item_id", "fingerprint"], "left_semi")
    last = dedupe_last(meant, "work_item_id", "changed_at", "seq")
    absent = missing_columns(snapshot, ("tags", "link", "bug_url"))
    if absent:
        kept = index.select("work_item_id", *absent).join(small_side(touched.select("work_item_id")), "work_item_id", "left_semi")
        kept = dedupe_first(kept, "work_item_id")
        last = last.drop(*absent).join(kept, "work_item_id", "left")
    return last.withColumn("embedding", embedder.column(record_text())).select(*INDEX_COLUMNS)


def diff_counts(diff: DataFrame) -> DataFrame:
    """Counts per status and whether anything changed, one row."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (NEW, MODIFIED, UNCHANGED)]
    return diff.agg(*counts).withColumn("changed", F.col(NEW) + F.col(MODIFIED) > 0)


def changed_rows(snapshot: DataFrame, diff: DataFrame) -> DataFrame:
    """Cleaned snapshot rows whose id is new or modified, in id order."""
    changed = diff.where(F.col("status") != UNCHANGED).select("work_item_id")
    rows = clean_records(snapshot).join(changed, "work_item_id", "left_semi")
    return rows.orderBy("work_item_id")


def refresh_delta(
    index: DataFrame,
    changes: DataFrame,
    embedder,
    *,
    skip_unchanged: bool = True,
    include_tags: bool = False,
    full_table: bool = False,
    renew: bool = False,
    scratch: str | None = None,
    dimensions: tuple[int | None, int | None] | None = None,
) -> DataFrame:
    """New and changed index rows with their ``status``; only these are embedded.

    ``skip_unchanged=False`` re-embeds every row of the feed, changed or not. ``full_table``
    says that the feed is a whole snapshot, whose rows without title are invalid. Columns that
    the feed does not have keep their stored value. A change older than the stored row is stale
    and skipped. The deduplicated feed is stored below ``scratch``, which the result reads. ``dimensions`` are the lengths
    of the shortest and longest stored vector, as a stored index knows them; without them all vectors are scanned.

    ``renew`` is for feeds whose batches may come in any order: a row that only confirms the stored one at a later time
    is skipped, but the stored row comes along as ``renewed`` with that time, vector and all, so that a change between
    the two times that arrives later still is stale. Stored rows are read in full only if there are such.
    """
    check_dimension(index, embedder.dim, dimensions)
    latest = latest_changes(changes, include_tags=include_tags, full_table=full_table)
    # Stored, as it is used twice and its size decides: while the ids of the feed are few enough
    # to broadcast, the index is only filtered; only then do its matches meet the feed.
    latest = materialize(latest, "changes", scratch)
    ids = small_side(latest.select("work_item_id"))
    stored = index.select(
        "work_item_id", "fingerprint", "tags", "link", "bug_url", "changed_at"
    ).join(ids, "work_item_id", "left_semi")
    # An index built from repeated records may hold an id twice: its first row stands for it.
    stored = dedupe_first(stored, "work_item_id", "changed_at")
    if renew:
        stored = materialize(stored, "stored", scratch)
    stale = F.coalesce(F.col("_old_changed_at") > F.col("changed_at"), F.lit(False))
    judged = classify(latest, stored).where(~stale)
    touched = judged
    if skip_unchanged:
        touched = touched.where(F.col("status") != UNCHANGED)
    absent = missing_columns(changes, ("tags", "link", "bug_url"))
    kept = {c: F.col(f"_old_{c}") for c in absent}
    embedded = touched.withColumns(kept).withColumn("embedding", embedder.column(record_text()))
    delta = embedded.select(*INDEX_COLUMNS, "status")
    if not (renew and skip_unchanged):
        return delta
    later = F.coalesce(F.col("changed_at") > F.col("_old_changed_at"), F.col("changed_at").isNotNull())
    confirmed = judged.where((F.col("status") == UNCHANGED) & later).select("work_item_id", "fingerprint", "changed_at")
    confirmed = materialize(confirmed, "confirmed", scratch)
    if confirmed.isEmpty():
        return delta
    return delta.unionByName(_renewed(index, confirmed, ids))


def _renewed(index: DataFrame, confirmed: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows of the ``confirmed`` ids with the later times; ``ids`` are those of the feed, measured."""
    rows = index.join(ids, "work_item_id", "left_semi")
    # With the fingerprint, so that of an id held twice the row that was confirmed is taken.
    met = rows.withColumnRenamed("changed_at", "_old_changed_at").join(confirmed, ["work_item_id", "fingerprint"])
    first = dedupe_first(met, "work_item_id", "_old_changed_at")
    return first.select(*INDEX_COLUMNS, F.lit(RENEWED).alias("status"))


def refresh(index: DataFrame, changes: DataFrame, embedder, **options) -> Refresh:
    """Apply a change feed; options as for :func:`refresh_delta`.

    The delta is written to the shared folder first, so its rows are classified and embedded once
    for all three results and the overlay knows its true size.
    """
    delta = materialize(refresh_delta(index, changes, embedder, **options), "delta")
    stats = refresh_stats(changes, delta.select("status"))
    return Refresh(delta, stats, overlay(index, delta.select(*INDEX_COLUMNS)))


def refresh_stats(changes: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows added, updated and skipped; duplicates and invalid input rows count as skipped."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    seen = changes.select(one.alias("n"), zero.alias("a"), zero.alias("u"))
    is_new = (F.col("status") == NEW).cast("bigint")
    done = touched.select(zero.alias("n"), is_new.alias("a"), (one - is_new).alias("u"))
    total = seen.unionAll(done).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("n", "a", "u")]
    )
    skipped = F.greatest(zero, F.col("n") - F.col("a") - F.col("u"))
    return total.select(
        F.col("a").alias("added"), F.col("u").alias("updated"), skipped.alias("skipped")
    )


def fingerprint_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new fingerprints per id; a non-empty new one wins."""
    left = old.select("work_item_id", F.col("fingerprint").alias("_old"))
    right = new.select("work_item_id", F.nullif("fingerprint", F.lit("")).alias("_new"))
    merged = left.join(right, "work_item_id", "full")
    value = F.coalesce("_new", "_old")
    return merged.select("work_item_id", value.alias("fingerprint")).where(value.isNotNull())


def fingerprint_audit(snapshot: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Per snapshot row: is its id known, and does the stored hash match, in both hash forms."""
    rows = canonical(snapshot)
    title, body = filled(F.col("title")), filled(F.col("semantic_text"))
    plain = F.coalesce(strip("work_item_id"), F.lit(""))
    hashed = rows.select(plain.alias("plain_id"), normalize_id(plain).alias("work_item_id"),
                         title.alias("title"), body.alias("semantic_text"))
    hashed = hashed.select(
        "plain_id",
        "work_item_id",
        fingerprint_undelimited(F.col("plain_id"), F.col("title"), F.col("semantic_text"))
        .alias("plain_hash"),
        fingerprint(F.col("work_item_id"), F.col("title"), F.col("semantic_text"))
        .alias("hash"),
    )
    by_plain = fingerprints.select(
        F.col("work_item_id").alias("plain_id"), F.col("fingerprint").alias("_plain_stored")
    )
    by_id = fingerprints.select("work_item_id", F.col("fingerprint").alias("_stored"))
    # Blank ids are one key that many rows may share, so a heavy key is joined in pieces.
    hashed = materialize(hashed, "hashed")
    plain_met = materialize(spread_join(hashed, by_plain, ["plain_id"], "left"), "plain-met")
    joined = spread_join(plain_met, by_id, ["work_item_id"], "left")
    no = F.lit(False)
    return joined.select(
        "plain_id",
        "work_item_id",
        "plain_hash",
        "hash",
        F.col("_plain_stored").isNotNull().alias("plain_id_known"),
        F.coalesce(F.col("_plain_stored") == F.col("plain_hash"), no).alias("plain_matches"),
        F.col("_stored").isNotNull().alias("id_known"),
        F.coalesce(F.col("_stored") == F.col("hash"), no).alias("matches"),
    )
