"""Hybrid (vector + keyword) search and upkeep of large record tables on Spark."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: task functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from recordlens.embedders import HashEmbedder  # noqa: E402
from recordlens.operators.cleaning import clean_records  # noqa: E402
from recordlens.operators.ordering import display_sort  # noqa: E402
from recordlens.operators.quality import is_normalized, row_alignment  # noqa: E402
from recordlens.plans.build import build_index, make_index, renormalize_index  # noqa: E402
from recordlens.plans.diagnostics import diagnostics, index_stats  # noqa: E402
from recordlens.plans.refresh import fingerprint_audit, refresh, snapshot_diff  # noqa: E402
from recordlens.plans.repair import augment_links, augment_links_from_workbooks, repair_url_file, repair_urls  # noqa: E402
from recordlens.plans.search import (  # noqa: E402
    lookup,
    present,
    search,
    search_batch,
    search_front,
)
from recordlens.session import configure  # noqa: E402
from recordlens.sources.records import (  # noqa: E402
    export_csv,
    export_fingerprint_object,
    export_fingerprints,
    incremental_pull,
    load_fingerprints,
    load_refresh_state,
    scan_metadata,
    scan_records,
)
from recordlens.sources.store import compact, load_index, publish_delta, publish_index, vacuum  # noqa: E402
from recordlens.sources.workbook import read_workbooks, workbook_links  # noqa: E402
from recordlens.streaming.refresh import apply_changes, refresh_from_mark, refresh_from_snapshot, start_refresh_stream  # noqa: E402

__all__ = [
    "HashEmbedder",
    "apply_changes",
    "augment_links",
    "augment_links_from_workbooks",
    "build_index",
    "clean_records",
    "compact",
    "configure",
    "diagnostics",
    "display_sort",
    "export_csv",
    "export_fingerprint_object",
    "export_fingerprints",
    "fingerprint_audit",
    "incremental_pull",
    "index_stats",
    "is_normalized",
    "load_fingerprints",
    "load_index",
    "load_refresh_state",
    "lookup",
    "make_index",
    "present",
    "publish_delta",
    "publish_index",
    "read_workbooks",
    "refresh",
    "refresh_from_mark",
    "refresh_from_snapshot",
    "renormalize_index",
    "repair_url_file",
    "repair_urls",
    "row_alignment",
    "scan_metadata",
    "scan_records",
    "search",
    "search_batch",
    "search_front",
    "snapshot_diff",
    "start_refresh_stream",
    "vacuum",
    "workbook_links",
]
