"""One function per registered query: ``(spark, folder of the tables) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordlens.embedders import HashEmbedder
from recordlens.functions.links import choose_link, clean_link
from recordlens.functions.text import (
    clean_text,
    embedding_text,
    fingerprint,
    id_to_int,
    normalize_id,
    strip,
)
from recordlens.functions.vectors import dot, l2_normalize, norm
from recordlens.operators.cleaning import clean_records
from recordlens.operators.dedupe import dedupe_first, dedupe_last
from recordlens.operators.ordering import display_keys, display_sort, with_positions
from recordlens.operators.quality import dimension_range, is_normalized, row_alignment, unaligned_ids
from recordlens.operators.scoring import keyword_score
from recordlens.plans.build import (
    build_index,
    make_index,
    record_text,
    renormalize_index,
    with_fingerprint,
)
from recordlens.plans.diagnostics import diagnostics, index_stats
from recordlens.plans.refresh import (
    changed_rows,
    diff_counts,
    fingerprint_audit,
    fingerprint_merge,
    refresh,
    snapshot_diff,
)
from recordlens.plans.repair import augment_links, augment_links_from_workbooks, repair_url_file, repair_urls
from recordlens.plans.search import lookup, present, search, search_batch, search_front
from recordlens.schema import canonical, schema_report
from recordlens.session import materialize, scratch_path
from recordlens.sources.records import (
    export_csv,
    export_fingerprints,
    incremental_pull,
    load_fingerprints,
    parse_fingerprint_map,
    parse_refresh_state,
    scan_metadata,
)
from recordlens.sources.store import load_index, publish_index, read_state
from recordlens.sources.workbook import evaluate_hyperlinks, resolve_shared, workbook_links
from recordlens.streaming.refresh import refresh_from_mark, refresh_from_snapshot, start_refresh_stream
from workload import inputs as given

EMBEDDER = HashEmbedder(64)
QUERY, QUERY_VECTOR, TOP = "the", 7, 10
STREAM_FILES = 3
LOOKUP_ID = "42"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _corpus(spark, folder) -> DataFrame:
    # About half of the documents have no vector in the given tables, and are left out on purpose.
    return make_index(given.linked_records(spark, folder), given.vectors(spark, folder), strict=False)


def _hash_index(spark, folder) -> DataFrame:
    return build_index(given.records(spark, folder), EMBEDDER)


def _event_index(spark, folder) -> DataFrame:
    """Index of the change feed up to the cut, one row per id."""
    until = given.changes_until(spark, folder)
    return build_index(dedupe_last(until, "BugID", "changed_at", "seq"), EMBEDDER)


def _refreshed_events(spark, folder):
    """Refresh of the stored index of the state at the cut by the rest of the feed."""
    base = scratch_path(spark, "events")
    publish_index(_event_index(spark, folder), base)
    state = read_state(spark, base)
    feed = given.changes_since(spark, folder)
    return refresh(load_index(spark, base), feed, EMBEDDER, dimensions=state.dimensions)


def _query_vector(spark, folder):
    rows = given.table(spark, folder, "embeddings")
    return rows.where(F.col("vec_id") == QUERY_VECTOR).select("embedding").scalar()


def _prints(records: DataFrame) -> DataFrame:
    return with_fingerprint(clean_records(records)).select("work_item_id", "fingerprint")


def _vector_entries(df: DataFrame, *keep: str) -> DataFrame:
    """One row per vector element, which compares in any engine."""
    # The outer form, as the plain one adds a filter that would embed every text twice.
    return df.select(*keep, F.posexplode_outer("embedding").alias("pos", "weight")).withColumn(
        "weight", F.col("weight").cast("double")
    )


# Sources and sinks


@query
def scan_records(spark, folder):
    rows = canonical(given.records(spark, folder))
    return rows.select(
        "work_item_id", "title", "tags", "link", F.length("semantic_text").alias("chars")
    )


@query
def incremental_pull_(spark, folder):
    events = given.table(spark, folder, "events")
    cut = F.lit(given.CUT).cast("timestamp_ntz")
    pulled = incremental_pull(events, cut, "ts")
    return given.as_changes(pulled).select(
        F.col("BugID").cast("string").alias("work_item_id"),
        F.col("Title").alias("title"),
        F.col("seq"),
    )


@query
def fingerprint_json_load(spark, folder):
    events = given.table(spark, folder, "events")
    return parse_fingerprint_map(events, F.col("props"), "event_id")


@query
def workbook_links_(spark, folder):
    return workbook_links(materialize(given.workbooks(spark, folder), "books"))


@query
def publish_snapshot(spark, folder):
    base = scratch_path(spark, "publish")
    publish_index(_hash_index(spark, folder), base)
    return load_index(spark, base).select("work_item_id", "title", "fingerprint")


@query
def published_vectors(spark, folder):
    """The vectors of a published index, element by element."""
    base = scratch_path(spark, "vectors")
    publish_index(_hash_index(spark, folder), base)
    return _vector_entries(load_index(spark, base), "work_item_id")


@query
def export_csv_(spark, folder):
    path = scratch_path(spark, "csv")
    rows = given.records(spark, folder).select("WorkItemId", "Title", "link")
    export_csv(rows, path)
    return scan_metadata(spark, path).select("work_item_id", "title", "link")


@query
def fingerprint_json_dump(spark, folder):
    """Fingerprints written as JSON lines, read back."""
    path = scratch_path(spark, "prints")
    export_fingerprints(_prints(given.records(spark, folder)), path)
    return load_fingerprints(spark, path)


@query
def fingerprint_merge_(spark, folder):
    old = _prints(given.records(spark, folder))
    new = _prints(given.revised_records(spark, folder))
    return fingerprint_merge(old, new)


@query
def build_index_(spark, folder):
    index = _hash_index(spark, folder)
    nonzero = F.size(F.filter("embedding", lambda x: x != 0))
    return index.select(
        "work_item_id",
        "title",
        "tags",
        F.length("semantic_text").alias("chars"),
        "fingerprint",
        F.size("embedding").alias("dim"),
        nonzero.alias("nonzero"),
    )


# Projections and filters


@query
def schema_check(spark, folder):
    return schema_report(given.records(spark, folder), ("work_item_id", "title", "bug_url"))


@query
def clean_records_(spark, folder):
    """Records whose id is missing unless labelled and whose body lacks the title line."""
    labels = given.table(spark, folder, "labels").select("doc_id", F.lit(True).alias("labelled"))
    docs = given.documents(spark, folder).join(labels, "doc_id", "left")
    title = given.first_line(F.col("text"))
    raw = docs.select(
        F.when(F.col("labelled"), F.concat(F.lit(" "), F.col("doc_id"), F.lit(".0")))
        .alias("WorkItemId"),
        title.alias("Title"),
        F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("SemanticText"),
    )
    return clean_records(raw).select("work_item_id", "title", "semantic_text")


@query
def normalize_id_(spark, folder):
    raw = _raw_ids(spark, folder)
    return raw.select("event_id", "raw_id", normalize_id(F.col("raw_id")).alias("work_item_id"))


def _raw_ids(spark, folder):
    kind = F.col("event_type")
    ending = (
        F.when(kind == "error", ".0").when(kind == "view", ".00").when(kind == "click", ".0.0")
    )
    raw = F.concat(
        F.lit(" "), F.col("user_id").cast("string"), F.coalesce(ending, F.lit("")), F.lit("\n")
    )
    return given.table(spark, folder, "events").select("event_id", raw.alias("raw_id"))


@query
def exact_lookup(spark, folder):
    index = clean_records(given.linked_records(spark, folder))
    return lookup(index, LOOKUP_ID)


@query
def changed_rows_(spark, folder):
    old = _prints(given.records(spark, folder))
    new = given.revised_records(spark, folder)
    rows = changed_rows(new, snapshot_diff(old, new))
    return rows.select("work_item_id", "title", F.length("semantic_text").alias("chars"))


@query
def url_repair(spark, folder):
    fixed, _ = repair_urls(given.linked_records(spark, folder), given.EDIT_URL)
    return fixed.select("work_item_id", "bug_url")


@query
def url_repair_count(spark, folder):
    return repair_urls(given.linked_records(spark, folder), given.EDIT_URL)[1]


@query
def url_repair_file(spark, folder):
    """URL repair from a CSV table to a new one, with the number of repaired rows."""
    source, target = scratch_path(spark, "urls"), scratch_path(spark, "urls-repaired")
    export_csv(given.linked_records(spark, folder).select("WorkItemId", "Title", "BugUrl"), source)
    repaired = repair_url_file(spark, source, target, given.EDIT_URL)
    rows = scan_metadata(spark, target if repaired else source)
    return rows.select("work_item_id", "title", "bug_url", F.lit(repaired).cast("bigint").alias("repaired"))


@query
def link_choice(spark, folder):
    rows = canonical(given.linked_records(spark, folder))
    return rows.select("work_item_id", choose_link(F.col("bug_url"), F.col("link")).alias("link"))


@query
def link_clean(spark, folder):
    """Links taken from numbers: zero counts as no link."""
    events = given.table(spark, folder, "events")
    raw = F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(" "))
    return events.select("event_id", clean_link(raw).alias("link"))


# Joins


@query
def corpus_join(spark, folder):
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return _corpus(spark, folder).select(
        "work_item_id",
        "title",
        "bug_url",
        "fingerprint",
        F.size("embedding").alias("dim"),
        total.alias("vector_sum"),
    )


@query
def corpus_left_out(spark, folder):
    """Ids that the join of records and vectors leaves out, with the side that lacks them."""
    return unaligned_ids(clean_records(given.records(spark, folder)), given.vectors(spark, folder))


@query
def row_alignment_(spark, folder):
    rows = canonical(given.records(spark, folder))
    return row_alignment(rows, given.vectors(spark, folder))


@query
def link_augment(spark, folder):
    rows = canonical(given.records(spark, folder).drop("link"))
    pages = given.table(spark, folder, "pages")
    links = pages.select(F.col("page_id").alias("work_item_id"), F.col("url").alias("link"))
    return augment_links(rows, links).select("work_item_id", "title", "link")


@query
def link_job(spark, folder):
    """Links from workbooks for records without any."""
    bare = given.records(spark, folder).drop("link")
    books = materialize(given.workbooks(spark, folder), "link-books")
    return augment_links_from_workbooks(bare, books).select("work_item_id", "title", "link")


@query
def link_job_kept(spark, folder):
    """As before, but some records have links of their own, so these stay and the workbooks are not read."""
    own = F.when(F.col("Tags") == "en", F.concat(F.lit("https://host/"), "link"))
    rows = given.records(spark, folder).withColumn("link", own)
    return augment_links_from_workbooks(rows, given.workbooks(spark, folder)).select("work_item_id", "title", "link")


@query
def hyperlink_formula(spark, folder):
    docs = given.documents(spark, folder)
    formula = F.concat(
        F.lit('=HYPERLINK("https://host/a,b&c/edit/"&$A'),
        F.col("doc_id") + 2,
        F.lit('&IF(B1>0,"x","y"),"open")'),
    )
    bare = F.lit('HYPERLINK("https://host/edit")')
    formulas = docs.select(
        F.col("source").alias("path"),
        F.col("doc_id").alias("row_order"),
        F.when(F.col("lang") == "en", bare).otherwise(formula).alias("formula"),
        F.col("doc_id").cast("string").alias("record_id"),
    )
    sheet = docs.select(
        F.col("source").alias("path"),
        F.col("doc_id").alias("row_order"),
        F.lit(1).alias("col"),
        F.when(F.col("lang") == "fr", "0").otherwise(F.concat(F.lit("r"), F.col("doc_id")))
        .alias("value"),
    )
    urls = evaluate_hyperlinks(formulas, sheet)
    return urls.select(F.col("row_order").alias("doc_id"), "url")


@query
def shared_formula(spark, folder):
    """Every source is a workbook whose first row holds the formula of all its rows; one source holds a third of them."""
    docs = given.documents(spark, folder)
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    row = F.col("doc_id") + 2
    text = F.concat(F.lit('HYPERLINK("https://host/edit/"&$A'), row, F.lit(',"row")'))
    cells = docs.join(first, "source").select(
        F.col("source").alias("path"),
        F.col("doc_id").alias("row_order"),
        row.alias("row"),
        F.when(F.col("doc_id") == F.col("first"), text).otherwise("").alias("formula"),
        F.lit("0").alias("shared"),
    )
    return resolve_shared(cells).select(F.col("row_order").alias("doc_id"), "formula")


@query
def shared_formula_reused(spark, folder):
    """As before, but each seventh document of a source starts the formula anew under the same number."""
    docs = given.documents(spark, folder)
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    row = F.col("doc_id") + 2
    text = F.concat(F.lit('HYPERLINK("https://host/'), F.col("doc_id"), F.lit('/"&$A'), row, F.lit(',"row")'))
    starts = (F.col("doc_id") == F.col("first")) | (F.col("doc_id") % 7 == 0)
    cells = docs.join(first, "source").select(
        F.col("source").alias("path"),
        F.col("doc_id").alias("row_order"),
        row.alias("row"),
        F.when(starts, text).otherwise("").alias("formula"),
        F.lit("0").alias("shared"),
    )
    return resolve_shared(cells).select(F.col("row_order").alias("doc_id"), "formula")


@query
def display_positions(spark, folder):
    """The place of every event in the descending display order of its value, ties by its number."""
    keyed = materialize(display_keys(_mixed_values(spark, folder), "value_text"), "display-keys")
    keys = [F.desc_nulls_last(c) for c in ("sort_class", "sort_number", "sort_text", "value_text")]
    return with_positions(keyed, [*keys, F.asc("event_id")]).select("event_id", "value_text", "position")


# Vectors and scores


@query
def vector_norm(spark, folder):
    rows = given.table(spark, folder, "embeddings")
    return rows.select("vec_id", norm(F.col("embedding")).alias("norm"))


@query
def is_normalized_(spark, folder):
    return is_normalized(given.vectors(spark, folder))


@query
def dim_check(spark, folder):
    return dimension_range(given.vectors(spark, folder))


def _stretched(spark, folder):
    """Embeddings scaled by their label, so most are off unit length and some are zero."""
    rows = given.table(spark, folder, "embeddings")
    factor = F.col("label").cast("float")
    scaled = F.transform("embedding", lambda x: (x * factor).cast("float"))
    return rows.select("vec_id", scaled.alias("embedding"))


@query
def l2_normalize_(spark, folder):
    unit = l2_normalize(F.col("embedding")).alias("embedding")
    return _vector_entries(_stretched(spark, folder).select("vec_id", unit), "vec_id")


@query
def renormalize_index_(spark, folder):
    return _vector_entries(renormalize_index(_stretched(spark, folder)), "vec_id")


@query
def hash_embed(spark, folder):
    cleaned = clean_records(given.records(spark, folder))
    embedded = cleaned.select("work_item_id", EMBEDDER.column(record_text()).alias("embedding"))
    return _vector_entries(embedded, "work_item_id")


@query
def keyword_score_(spark, folder):
    cleaned = clean_records(given.records(spark, folder))
    score = keyword_score(
        F.lit(" The "), F.col("work_item_id"), F.col("title"), F.col("semantic_text")
    )
    return cleaned.select("work_item_id", score.alias("keyword_score"))


@query
def cosine_topk(spark, folder):
    rows = given.table(spark, folder, "embeddings")
    asked = rows.withColumn("query", _query_vector(spark, folder))
    score = dot(F.col("query"), F.col("embedding"))
    scored = asked.select("vec_id", "label", score.alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(TOP)


@query
def hybrid_topk(spark, folder):
    vector = _query_vector(spark, folder)
    return search(_corpus(spark, folder), QUERY, TOP, vector=vector)


@query
def batch_topk(spark, folder):
    found = search_batch(
        _hash_index(spark, folder), given.query_table(spark, folder), 5, embedder=EMBEDDER
    )
    return found.select(
        "query_id", "rank", "work_item_id", "title", "semantic_score", "keyword_score",
        "final_score",
    )


@query
def match_pct(spark, folder):
    return present(hybrid_topk(spark, folder)).select("rank", "match", "work_item_id", "title")


@query
def search_front_(spark, folder):
    found = search_front(_hash_index(spark, folder), "error in the", 5, embedder=EMBEDDER)
    return found.select("rank", "match", "work_item_id", "title", "link", "final_score")


@query
def exact_front(spark, folder):
    """The front of the search for an id that the index holds."""
    found = search_front(_hash_index(spark, folder), f" {LOOKUP_ID} ", 5, embedder=EMBEDDER)
    return found.select("rank", "match", "work_item_id", "title", "link", "final_score")


# Aggregates and dedupe


@query
def index_counts(spark, folder):
    """Counts of the refreshed index, with those of its last refresh."""
    done = _refreshed_events(spark, folder)
    return index_stats(done.index, done.stats)


@query
def refresh_stats(spark, folder):
    return _refreshed_events(spark, folder).stats


@query
def index_upsert(spark, folder):
    done = _refreshed_events(spark, folder)
    nonzero = F.size(F.filter("embedding", lambda x: x != 0))
    return done.index.select(
        "work_item_id", "title", "semantic_text", "fingerprint",
        F.col("changed_at").cast("string").alias("changed_at"), nonzero.alias("nonzero"),
    )


@query
def snapshot_diff_(spark, folder):
    old = _prints(given.records(spark, folder))
    return snapshot_diff(old, given.revised_records(spark, folder))


@query
def snapshot_diff_counts(spark, folder):
    return diff_counts(snapshot_diff_(spark, folder))


@query
def dedupe_first_(spark, folder):
    feed = given.changes(spark, folder)
    first = dedupe_first(feed, "BugID", "changed_at", "seq")
    return first.select(F.col("BugID").alias("user_id"), "Title", "SemanticText", "seq")


@query
def dedupe_last_(spark, folder):
    feed = given.changes(spark, folder)
    last = dedupe_last(feed, "BugID", "changed_at", "seq")
    return last.select(F.col("BugID").alias("user_id"), "Title", "SemanticText", "seq")


@query
def fingerprint_audit_(spark, folder):
    snapshot = given.revised_records(spark, folder)
    return fingerprint_audit(snapshot, _prints(given.records(spark, folder)))


# Scalar functions


@query
def strip_text(spark, folder):
    pages = given.table(spark, folder, "pages")
    padded = F.concat(F.lit("\t  "), F.col("html"), F.lit(" \r\n"))
    return pages.select("page_id", strip(padded).alias("text"))


@query
def clean_text_(spark, folder):
    turns = given.table(spark, folder, "conversations")
    spoiled = F.when(F.col("role") == "user", F.lit(" NaN ")).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", clean_text(spoiled).alias("text"))


@query
def embedding_text_(spark, folder):
    docs = given.documents(spark, folder)
    tags = F.when(F.col("lang") == "en", F.lit("none")).otherwise(F.col("lang"))
    text = embedding_text(given.first_line(F.col("text")), tags, F.col("text"))
    return docs.select("doc_id", text.alias("text"), F.length(text).alias("chars"))


@query
def fingerprint_(spark, folder):
    docs = given.documents(spark, folder)
    value = fingerprint(F.col("doc_id").cast("string"), F.col("source"), F.col("text"))
    return docs.select("doc_id", value.alias("fingerprint"))


@query
def id_to_int_(spark, folder):
    events = given.table(spark, folder, "events")
    kind = F.col("event_type")
    user, value = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    raw = (
        F.when(kind == "error", F.concat(user, F.lit("."), value))
        .when(kind == "view", F.concat(F.lit("-"), user, F.lit("e1")))
        .when(kind == "click", F.concat(kind, user))
        .otherwise(user)
    )
    return events.select("event_id", raw.alias("raw_id"), id_to_int(raw).alias("id"))


@query
def display_sort_(spark, folder):
    """Mixed values of all events in descending display order, with their sort keys."""
    return display_sort(_mixed_values(spark, folder), "value_text", desc=True)


def _mixed_values(spark, folder):
    kind, value = F.col("event_type"), F.get_json_object("props", "$.k")
    text = (
        F.when(kind == "error", F.concat(value, F.lit(".5%")))
        .when(kind == "view", value)
        .when(kind == "click", F.concat(F.lit("Item "), value))
        .otherwise("")
    )
    return given.table(spark, folder, "events").select("event_id", text.alias("value_text"))


# Composite jobs


@query
def diagnostics_report(spark, folder):
    raw = given.linked_records(spark, folder)
    newest = F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    state = given.table(spark, folder, "events").agg(newest.alias("last_refresh_time"))
    state = parse_refresh_state(state.select(F.to_json(F.struct("last_refresh_time")).alias("j")), F.col("j"))
    return diagnostics(
        raw,
        given.vectors(spark, folder),
        state,
        _hash_index(spark, folder),
        embedder=EMBEDDER,
    )


@query
def stream_refresh(spark, folder):
    """Index of the state at the cut, then the whole feed as a stream of several batches, folded in between."""
    base = scratch_path(spark, "stream")
    publish_index(_event_index(spark, folder), base)
    feed = given.changes(spark, folder)
    # One file a batch. Batches may come in any order, as a change older than the stored row is skipped.
    feed.repartitionByRange(STREAM_FILES, "changed_at").write.parquet(f"{base}/feed")
    events = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    running = start_refresh_stream(events, base, EMBEDDER, f"{base}/progress", most_deltas=1)
    running.awaitTermination()
    return load_index(spark, base).select("work_item_id", "title", "semantic_text", "fingerprint")


@query
def pull_refresh(spark, folder):
    """A stored index refreshed by all that the feed holds since its newest change, that moment included."""
    base = scratch_path(spark, "pull")
    publish_index(_event_index(spark, folder), base)
    stats = refresh_from_mark(base, given.changes(spark, folder), EMBEDDER)
    rows = load_index(spark, base).select("work_item_id", "title", "semantic_text", "fingerprint")
    return rows.withColumns({name: F.lit(value).cast("bigint") for name, value in stats.items()})


@query
def snapshot_refresh(spark, folder):
    """A stored index refreshed from a later snapshot: difference, vectors, upsert, write, counts."""
    base = scratch_path(spark, "snapshot")
    publish_index(_hash_index(spark, folder), base)
    stats = refresh_from_snapshot(spark, base, given.revised_records(spark, folder), EMBEDDER)
    index = load_index(spark, base).select("work_item_id", "title", "fingerprint", F.size(F.filter("embedding", lambda x: x != 0)).alias("nonzero"))
    counts = {name: F.lit(value).cast("bigint") for name, value in stats.items()}
    return index.withColumns(counts)


def named() -> dict[str, Query]:
    """Queries by name; a trailing underscore only keeps clear of an imported name."""
    return {name.rstrip("_"): fn for name, fn in QUERIES.items()}
