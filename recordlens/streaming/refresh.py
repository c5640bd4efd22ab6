"""Refresh of a stored index, in one batch or as a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recordlens.plans.build import check_dimension
from recordlens.plans.refresh import MODIFIED, NEW, RENEWED, UNKNOWN, bucketed_diff, diff_counts, refresh_delta, snapshot_delta
from recordlens.schema import INDEX_COLUMNS
from recordlens.session import discard, materialize, scratch_path
from recordlens.sources.records import high_water_mark
from recordlens.sources.store import MOST_DELTAS, StaleWrite, compact, load_index, publish_delta, read_state


def apply_changes(
    base_path: str, changes: DataFrame, embedder, *, tag: str | None = None, most_deltas: int = MOST_DELTAS, **options
) -> dict[str, int]:
    """Refresh the index below ``base_path`` and return added, updated and skipped counts.

    Only the delta is written, and all counts are taken while the feed is read and the delta written. Rows that confirm a
    stored one at a later time count as skipped, but that time is kept. With a ``tag`` the call
    can be repeated: once its delta is committed, a later call returns the counts of the first. If another writer commits rows
    meanwhile, the delta is made anew from the newest state. Then the deltas are compacted when there are over
    ``most_deltas``.
    """
    spark = changes.sparkSession
    while True:
        state = read_state(spark, base_path)
        if tag in state.tags:
            return _as_counts(state.tags[tag]["stats"])
        scratch = scratch_path(spark, "refresh")
        try:
            seen = _publish_changes(base_path, state, changes, embedder, scratch, tag, options)
            break
        except StaleWrite:
            continue
        finally:
            discard(spark, scratch)
    if tag:
        # Another attempt of the same tag may have won; its counts are the committed ones.
        seen = read_state(spark, base_path).tags[tag]["stats"]
    compact(spark, base_path, most_deltas)
    return _as_counts(seen)


def refresh_from_mark(base_path: str, feed: DataFrame, embedder, **options) -> dict[str, int]:
    """Refresh the index below ``base_path`` by what ``feed`` holds since the newest change the index knows.

    Rows of that very moment are read again, as more of them may have come since; those the index has are skipped by
    their fingerprints. The comparison reaches the scan of the feed. An index without times takes the whole feed.
    """
    mark = high_water_mark(load_index(feed.sparkSession, base_path)).first().last_refresh_time
    since = feed if mark is None else feed.where(F.col("changed_at") >= F.lit(mark))
    return apply_changes(base_path, since, embedder, **options)


def _publish_changes(base_path, state, changes, embedder, scratch, tag, options) -> dict[str, int]:
    spark = changes.sparkSession
    index = load_index(spark, base_path, state.version)
    read, written = Observation(), Observation()
    feed = changes.observe(read, F.count(F.lit(1)).alias("rows"))
    known = state.dimensions or UNKNOWN
    delta = refresh_delta(index, feed, embedder, renew=True, scratch=scratch, dimensions=known, **options)
    counted = delta.observe(
        written,
        F.count_if(F.col("status") == NEW).alias("added"),
        F.count_if(~F.col("status").isin(NEW, RENEWED)).alias("updated"),
    )
    seen = _Together(read, written)
    publish_delta(counted.select(*INDEX_COLUMNS), base_path, tag, after=state.version, counted=seen)
    return dict(seen.get)


class _Together:
    """The measures of several observations as one."""

    def __init__(self, *observations: Observation):
        self.observations = observations

    @property
    def get(self) -> dict:
        return {k: v for o in self.observations for k, v in o.get.items()}


def _as_counts(seen: dict) -> dict[str, int]:
    skipped = max(0, seen["rows"] - seen["added"] - seen["updated"])
    return {"added": seen["added"], "updated": seen["updated"], "skipped": skipped}


def refresh_from_snapshot(
    spark: SparkSession, base_path: str, snapshot: DataFrame, embedder, *, include_tags: bool = False,
    tag: str | None = None, most_deltas: int = MOST_DELTAS,
) -> dict[str, int]:
    """Bring the index below ``base_path`` to a full snapshot in one job; nothing is deleted. Counts of ids by status.

    Only ids and hashes of the snapshot meet those of the index, grouped by bucket: buckets with equal digests on both
    sides are skipped, so an index that barely changed is barely joined. Texts are read again for the changed ids only,
    and just these are embedded and written, as one delta.
    """
    while True:
        state = read_state(spark, base_path)
        if tag in state.tags:
            return state.tags[tag]["stats"]
        index = load_index(spark, base_path, state.version)
        check_dimension(index, embedder.dim, state.dimensions or UNKNOWN)
        scratch = scratch_path(spark, "snapshot-refresh")
        try:
            diff = materialize(bucketed_diff(index, snapshot, include_tags=include_tags, folder=scratch), "diff", scratch)
            counts = diff_counts(diff).drop("changed").first().asDict()
            delta = snapshot_delta(index, snapshot, diff, embedder, include_tags=include_tags)
            if counts[NEW] + counts[MODIFIED]:
                publish_delta(delta, base_path, tag, after=state.version, counted=_Counted(counts))
            break
        except StaleWrite:
            continue
        finally:
            discard(spark, scratch)
    compact(spark, base_path, most_deltas)
    return counts


class _Counted:
    """Counts that are known already, in the place of an observation."""

    def __init__(self, counts: dict[str, int]):
        self.get = counts


def start_refresh_stream(
    stream: DataFrame,
    base_path: str,
    embedder,
    checkpoint: str,
    *,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Keep the index below ``base_path`` current from a streaming change feed.

    State lives in the index itself, so the stream needs no watermark, batches may come in any order, and a batch repeated
    after a failure finds its own tag committed. Batches are numbered per checkpoint folder, so its name is part of their tags. Deltas are compacted
    between batches.
    """
    owner = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_changes(base_path, batch, embedder, tag=f"{owner}-{batch_id}", **options)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
