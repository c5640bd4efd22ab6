"""Secret scan: candidates by pattern, then what the whole corpus says about who owns them.

Built-in DataFrame functions only. Candidates are found per text; their hashes are counted over the
corpus by the documents (repositories) and sources (owners) they occur in. Both decide, by measures that do not change with
the size of the corpus: the effective number of owners, (sum of documents)^2 / (sum of squares of documents per owner),
which is 1 for a value of one owner however often that owner copies it, and n for one that n owners hold alike;
and the share of all owners. A value spread over more than ``max_owners`` effective owners, or held by more owners than
that and over ``owner_share`` of all, is an example someone copied. All others look live: a key stays live when its
owner copies it into many rows, or when a few others quote it. Counting combines in each task before it shuffles, so a
value in a third of all rows costs one row per task.

Kinds: ``assign``, ``access`` and ``hex`` are always reported. ``bare`` spans (a long run of
letters and digits outside any of those) are reported only when their owners make them look live.

Defined cases: null text is empty and has no spans; a null source is an owner of its own. Repeated rows
are separate documents with a row each. Offsets count code points, ends are exclusive. Extra columns are
ignored by the scan and kept by the redaction; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recordlens.llm.common import UID, fields, let, numbered_rows, prefix_sums, with_uid
from recordlens.session import materialize, scratch_path

ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Runs are maximal, so the smallest length can be part of these two patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
)
# kind, pattern, group that holds the value, shortest value
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("bare", BARE, 0, 20))
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,hash:bigint>>"


def _spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, shortest: int) -> Column:
    """Spans of one kind in order: gaps between the matches and the matches' lengths give the offsets."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))

    def build(found: Column) -> Column:
        steps = F.zip_with(found["gaps"], found["whole"], lambda g, w: g + F.coalesce(F.length(w), F.lit(0)))
        before = prefix_sums(steps)
        starts = F.zip_with(before, found["gaps"], lambda b, g: b + g)
        spans = F.transform(
            F.arrays_zip(
                F.slice(starts, F.lit(1), F.size(found["whole"])).alias("s"),
                found["whole"].alias("w"),
                found["value"].alias("v"),
            ),
            lambda z: F.struct(
                z["s"].alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind).alias("kind"),
                (z["s"] + F.length(z["w"])).alias("end"),
                F.when(F.length(z["v"]) >= shortest, F.xxhash64(z["v"])).alias("hash"),
            ),
        )
        return F.filter(spans, lambda s: s["hash"].isNotNull())

    found = F.struct(whole.alias("whole"), value.alias("value"), gaps.alias("gaps"))
    return F.when(text.rlike(pattern), let(found, build)).otherwise(F.array()).cast(SPAN)


def candidate_spans(text: Column) -> Column:
    """All candidates of a text by start, then kind as listed; ``bare`` ones only outside the others."""
    clean = F.coalesce(text, F.lit(""))
    by_kind = [_spans_of(clean, i, *kind) for i, kind in enumerate(KINDS)]
    base = F.flatten(F.array(*by_kind[:-1]))

    def merge(b: Column) -> Column:
        def free(s: Column) -> Column:
            return ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))

        return F.array_sort(F.concat(b, F.filter(by_kind[-1], free)))

    return let(base, merge)


def _text_of(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def has_candidates(text: Column) -> Column:
    clean = F.coalesce(text, F.lit(""))
    return reduce(Column.__or__, [clean.rlike(pattern) for _, pattern, _, _ in KINDS])


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_docs, n_owners, effective_owners over all rows with candidates (``spans``, ``source``)."""
    each = found.select("source", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    per_owner = each.groupBy("hash", "source").agg(F.count("*").alias("docs"))
    docs = F.col("docs").cast("double")
    return per_owner.groupBy("hash").agg(
        F.sum("docs").alias("n_docs"),
        F.count("*").alias("n_owners"),
        (F.sum(docs) * F.sum(docs) / F.sum(docs * docs)).alias("effective_owners"),
    )


def scan(docs: DataFrame, max_owners: int = 3, owner_share: float = 0.5) -> DataFrame:
    """Spans of every row: uid, doc_id, spans (all candidates), live (hashes that look live).

    ``docs`` has doc_id, text and source.
    """
    return _scan(with_uid(docs), scratch_path(docs.sparkSession, "secrets"), max_owners, owner_share)


def _scan(rows: DataFrame, folder: str, max_owners: int, owner_share: float) -> DataFrame:
    """The scan of rows that have their numbers, written below ``folder``."""
    spans = candidate_spans(F.col("text"))
    every = materialize(rows.select(UID, "doc_id", "source", spans.alias("spans")), "spans", folder)
    found = every.where(F.size("spans") > 0)
    all_owners = every.select("source").distinct().select(F.count(F.lit(1))).scalar()
    widely = (F.col("n_owners") > max_owners) & (F.col("n_owners") > owner_share * all_owners)
    owners = ownership(found).where((F.col("effective_owners") <= max_owners) & ~widely)
    mine = found.select(UID, F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    live = mine.join(owners, "hash").groupBy(UID).agg(F.array_sort(F.collect_list("hash")).alias("live"))
    return every.join(live, UID, "left").select(
        UID, "doc_id", "spans", F.coalesce("live", F.array().cast("array<bigint>")).alias("live")
    )


def report(scanned: DataFrame) -> DataFrame:
    """One row per document with counts and digests of its spans."""
    base = F.filter("spans", lambda s: s["kind"] != "bare")
    all_spans = F.filter("spans", lambda s: (s["kind"] != "bare") | F.array_contains("live", s["hash"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    n_live = F.size(F.filter("spans", lambda s: F.array_contains("live", s["hash"]))).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_text_of(base), 256).alias("base_sha256"),
        _text_of(all_spans).alias("spans"),
        n_live.alias("n_live"),
    )


def redact(docs: DataFrame, max_owners: int = 3, mark: str = "[SECRET]", owner_share: float = 0.5) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark``; same rows and columns.

    Only rows with candidates are joined; all others pass by without a shuffle. Overlapping spans are replaced
    as one. A column n_chars, when there is one, follows the new text.
    """
    folder = scratch_path(docs.sparkSession, "secrets")
    rows = numbered_rows(docs, folder)
    live = (
        _scan(fields(rows, "doc_id", "text", "source"), folder, max_owners, owner_share)
        .select(UID, F.filter("spans", lambda s: F.array_contains("live", s["hash"])).alias("live"))
        .where(F.size("live") > 0)
    )
    own = F.col("row.text")
    touched = rows.where(has_candidates(own)).join(live, UID, "left")
    text = F.when(F.size("live") > 0, _without(own, F.col("live"), mark)).otherwise(own)
    touched = touched.select("row", text.alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    touched = touched.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    untouched = rows.where(~has_candidates(own)).select("row.*")
    return untouched.unionByName(touched)


def _without(text: Column, spans: Column, mark: str) -> Column:
    """Text with sorted, possibly overlapping spans replaced."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        apart = (s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (acc["at"] == 0))
        parts = F.when(apart, F.concat(acc["parts"], F.array(F.concat(gap, F.lit(mark))))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    def finish(acc: Column) -> Column:
        rest = F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(acc["parts"], ""), rest)

    return F.aggregate(spans, start, step, finish)
