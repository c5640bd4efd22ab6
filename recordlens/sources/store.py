"""The stored index: a log of versions over immutable parquet folders.

``<base>/snapshots/…`` holds whole tables and ``<base>/deltas/…`` only new or changed rows, so a refresh writes what changed
rather than the whole index. Every write goes to a folder of its own attempt and is never modified afterwards. It counts once
its manifest ``<base>/log/v<number>.json`` exists, and that file is created only if it is absent: of two attempts at one
version the first committed wins, and readers of older versions are not disturbed.

A manifest is the whole state of its version: the snapshot and the deltas above it, each with the last version it covers,
its rows and the lengths of its vectors, and the tags of recent writes. So a reader opens one manifest, and a snapshot that
folds deltas covers just those it has read: deltas committed meanwhile stay above it. ``compact`` merges or folds deltas by
their number, which bounds what a read has to overlay, however many batches were written.

Committing renames a finished file without overwriting, which is atomic on HDFS. On a store without such a rename, let one
writer at a time commit.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from recordlens.operators.joins import BROADCAST_BYTES, small_side
from recordlens.session import discard

SNAPSHOTS, DELTAS, LOG = "snapshots", "deltas", "log"
MOST_DELTAS, RECENT_TAGS, FOLD_SHARE = 8, 64, 0.25
_NAME = re.compile(r"^v(\d+)(?:-(.+?))?(?:\.[0-9a-f]{32})?$")
_MANIFEST = re.compile(r"^v(\d+)\.json$")


class StaleWrite(RuntimeError):
    """Another write was committed since the version that this one was made from."""


@dataclass(frozen=True)
class Version:
    number: int
    kind: str
    tag: str | None
    path: str
    committed: bool


@dataclass(frozen=True)
class Entry:
    """A folder of the index: what it covers, and the statistics taken while it was written."""

    kind: str
    folder: str
    upto: int
    rows: int
    min_dim: int | None = None
    max_dim: int | None = None


@dataclass(frozen=True)
class State:
    """The index as of one version: entries (snapshot first, deltas in order) and recent writes by tag."""

    version: int = 0
    entries: tuple[Entry, ...] = ()
    tags: dict[str, dict] = field(default_factory=dict)
    last: dict = field(default_factory=dict)

    @property
    def snapshot(self) -> Entry | None:
        return self.entries[0] if self.entries else None

    @property
    def deltas(self) -> tuple[Entry, ...]:
        return self.entries[1:]

    @property
    def dimensions(self) -> tuple[int, int] | None:
        """Shortest and longest stored vector, or None when there is none."""
        found = [(e.min_dim, e.max_dim) for e in self.entries if e.min_dim is not None]
        return (min(f[0] for f in found), max(f[1] for f in found)) if found else None


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    root = _path(spark, folder)
    fs = _fs(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def _committed(spark: SparkSession, base_path: str) -> list[int]:
    found = [_MANIFEST.match(n) for n in _names(spark, f"{base_path}/{LOG}")]
    return sorted(int(m[1]) for m in found if m)


def _manifest(base_path: str, number: int) -> str:
    return f"{base_path}/{LOG}/v{number:010d}.json"


def read_state(spark: SparkSession, base_path: str, version: int | None = None) -> State:
    """The state as of ``version`` (default: newest); an empty state where nothing was committed by then."""
    numbers = [n for n in _committed(spark, base_path) if version is None or n <= version]
    if not numbers:
        return State()
    path = _path(spark, _manifest(base_path, numbers[-1]))
    stream = _fs(spark, path).open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    raw = json.loads(text)
    return State(raw["version"], tuple(Entry(**e) for e in raw["entries"]), raw["tags"], raw["last"])


def _commit(spark: SparkSession, base_path: str, state: State) -> bool:
    """Create the manifest of ``state`` unless its version has one; True when this call created it."""
    final = _path(spark, _manifest(base_path, state.version))
    fs = _fs(spark, final)
    if fs.exists(final):
        return False
    draft = _path(spark, f"{base_path}/{LOG}/.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(json.dumps(asdict(state)).encode())
    stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), no_overwrite)
    except Exception:
        fs.delete(draft, False)
        if fs.exists(final):
            return False
        raise
    return True


def versions(spark: SparkSession, base_path: str) -> list[Version]:
    """All versions below ``base_path``, oldest first, with folders of writes that were never committed."""
    numbers = _committed(spark, base_path)
    found, used = [], set()
    for number in numbers:
        state = read_state(spark, base_path, number)
        last = state.last
        found.append(Version(number, last["kind"], last["tag"], f"{base_path}/{last['folder']}", True))
        used |= {last["folder"], *(e.folder for e in state.entries)}
    for kind in (SNAPSHOTS, DELTAS):
        for folder in _names(spark, f"{base_path}/{kind}"):
            name = _NAME.match(folder)
            if name and f"{kind}/{folder}" not in used and int(name[1]) not in numbers:
                found.append(Version(int(name[1]), kind, name[2], f"{base_path}/{kind}/{folder}", False))
    return sorted(found, key=lambda v: v.number)


def next_version(known: list[Version], tag: str | None = None) -> int:
    """Number for a new version; a repeated ``tag`` gets its old number back."""
    if tag is not None:
        for v in known:
            if v.tag == tag and v.committed:
                return v.number
    return max((v.number for v in known), default=0) + 1


def _write(df: DataFrame, base_path: str, kind: str, number: int, tag: str | None) -> dict:
    """Write one attempt; its folder, rows and vector lengths, counted while writing."""
    folder = f"{kind}/v{number:010d}{'-' + tag if tag else ''}.{uuid.uuid4().hex}"
    seen = Observation()
    measures = [F.count(F.lit(1)).alias("rows")]
    if "embedding" in df.columns:
        length = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
        measures += [F.min(length).alias("min_dim"), F.max(length).alias("max_dim")]
    # Bloom filters let an exact lookup skip the row groups without the id.
    writer = df.observe(seen, *measures).write.option("parquet.bloom.filter.enabled#work_item_id", True)
    writer.parquet(f"{base_path}/{folder}")
    return {"kind": kind, "folder": folder, **seen.get}


def _publish(
    df: DataFrame, base_path: str, kind: str, tag: str | None,
    *, covers: int | None = None, after: int | None = None, counted: Observation | None = None,
) -> int:
    """Write ``df`` and commit it; ``covers`` says that it holds what the versions up to there hold, and nothing new."""
    spark = df.sparkSession
    tags = read_state(spark, base_path).tags
    if tag in tags:
        return tags[tag]["version"]
    number = next_version(_numbers_in_use(spark, base_path))
    written = _write(df, base_path, kind, number, tag)
    folder = f"{base_path}/{written['folder']}"
    while True:
        # Every try starts from the newest state, so the history is linear and nothing committed meanwhile is lost.
        state = read_state(spark, base_path)
        if tag in state.tags:
            discard(spark, folder)
            return state.tags[tag]["version"]
        try:
            _check(state, written, whole=kind == SNAPSHOTS, after=after)
        except (StaleWrite, ValueError):
            discard(spark, folder)
            raise
        number = max(number, state.version + 1)
        entry = Entry(**written, upto=number if covers is None else covers)
        tags = dict(state.tags)
        if tag:
            tags[tag] = {"version": number, "stats": dict(counted.get) if counted else {}}
        content = number if covers is None else state.last.get("content", 0)
        last = {"kind": kind, "tag": tag, "folder": entry.folder, "content": content}
        following = State(number, _with(state, entry, covers), dict(list(tags.items())[-RECENT_TAGS:]), last)
        if _commit(spark, base_path, following):
            return number


def _check(state: State, written: dict, whole: bool, after: int | None) -> None:
    content = state.last.get("content", 0)
    if after is not None and content > after:
        raise StaleWrite(f"version {content} was committed after version {after}")
    low, high = written.get("min_dim"), written.get("max_dim")
    known = None if whole else state.dimensions
    if low is not None and (low != high or (known and known != (low, high))):
        stored = f"index {known[0]} to {known[1]}, " if known else ""
        raise ValueError(f"embedding dimension mismatch: {stored}new {low} to {high}")


def _with(state: State, entry: Entry, covers: int | None) -> tuple[Entry, ...]:
    """Entries of ``state`` and the new one, without those it covers."""
    above = tuple(e for e in state.deltas if e.upto > entry.upto)
    if entry.kind == SNAPSHOTS:
        return (entry, *above)
    if state.snapshot is None:
        raise FileNotFoundError("a delta needs an index below it")
    below = () if covers is not None else tuple(e for e in state.deltas if e.upto <= entry.upto)
    return (state.snapshot, *below, entry, *above)


def _numbers_in_use(spark: SparkSession, base_path: str) -> list[Version]:
    """Versions by their names, committed or not, without opening a manifest."""
    numbers = set(_committed(spark, base_path))
    for kind in (SNAPSHOTS, DELTAS):
        numbers |= {int(m[1]) for m in map(_NAME.match, _names(spark, f"{base_path}/{kind}")) if m}
    return [Version(n, "", None, "", False) for n in sorted(numbers)]


def publish_index(index: DataFrame, base_path: str, tag: str | None = None) -> int:
    """Write a whole index as the next version. All its vectors must be of one length."""
    return _publish(index, base_path, SNAPSHOTS, tag)


def publish_delta(delta: DataFrame, base_path: str, tag: str | None = None, **options) -> int:
    """Write new and changed rows as the next version; a tag that was committed before keeps its version and is not written.

    ``after`` makes it a :class:`StaleWrite` error if rows were committed since that version; vectors must have the length
    of the stored ones.
    """
    return _publish(delta, base_path, DELTAS, tag, **options)


def _read(spark: SparkSession, base_path: str, entry: Entry, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{base_path}/{entry.folder}")


def _newest_rows(spark: SparkSession, base_path: str, deltas: tuple[Entry, ...], schema) -> DataFrame:
    """One row per id of the deltas, from the last that has it."""
    if len(deltas) == 1:
        return _read(spark, base_path, deltas[0], schema)
    numbered = None
    for entry in deltas:
        rows = _read(spark, base_path, entry, schema).withColumn("_version", F.lit(entry.upto).cast("bigint"))
        numbered = rows if numbered is None else numbered.unionByName(rows)
    # The join leaves the columns separate, so a reader of few of them scans only those.
    newest = numbered.groupBy("work_item_id").agg(F.max("_version").alias("_version"))
    return numbered.join(newest, ["work_item_id", "_version"], "left_semi").drop("_version")


def _load(spark: SparkSession, base_path: str, state: State) -> DataFrame:
    if state.snapshot is None:
        raise FileNotFoundError(f"no committed index below {base_path}")
    base = _read(spark, base_path, state.snapshot)
    if not state.deltas:
        return base
    return overlay(base, _newest_rows(spark, base_path, state.deltas, base.schema))


def load_index(spark: SparkSession, base_path: str, version: int | None = None) -> DataFrame:
    """Index as of ``version`` (default: newest): a snapshot overlaid with the deltas above it."""
    return _load(spark, base_path, read_state(spark, base_path, version))


def compact(
    spark: SparkSession, base_path: str, most_deltas: int = MOST_DELTAS, fold_share: float = FOLD_SHARE
) -> int | None:
    """Bound the deltas that a read overlays: with over ``most_deltas``, write them as one.

    They become one delta while they have at most ``fold_share`` of the snapshot's rows, else a new snapshot. Either covers
    what was read, and later deltas stay above it. Returns the new version, or None when there was nothing to do.
    """
    state = read_state(spark, base_path)
    if len(state.deltas) <= most_deltas:
        return None
    covers = state.deltas[-1].upto
    if sum(e.rows for e in state.deltas) <= fold_share * state.snapshot.rows:
        schema = _read(spark, base_path, state.snapshot).schema
        merged = _newest_rows(spark, base_path, state.deltas, schema)
        return _publish(merged, base_path, DELTAS, None, covers=covers)
    return _publish(_load(spark, base_path, state), base_path, SNAPSHOTS, None, covers=covers)


def vacuum(spark: SparkSession, base_path: str, keep: int = 10) -> list[str]:
    """Delete the manifests older than the last ``keep``, and the folders that no kept version and no newer write uses.

    Run it when no reader needs an older version. Returns the deleted paths.
    """
    numbers = _committed(spark, base_path)
    kept = numbers[-keep:]
    used = {e.folder for n in kept for e in read_state(spark, base_path, n).entries}
    gone = [_manifest(base_path, n) for n in numbers if n not in kept]
    for kind in (SNAPSHOTS, DELTAS):
        for folder in _names(spark, f"{base_path}/{kind}"):
            name = _NAME.match(folder)
            if name and f"{kind}/{folder}" not in used and kept and int(name[1]) <= kept[-1]:
                gone.append(f"{base_path}/{kind}/{folder}")
    for path in gone:
        discard(spark, path)
    return gone


def overlay(index: DataFrame, delta: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of the stored ``delta`` replace those of ``index`` with the same id or are appended.

    Up to ``limit`` bytes of ids the index is filtered in place; beyond it both are shuffled.
    """
    ids = small_side(delta.select("work_item_id"), limit)
    kept = index.join(ids, "work_item_id", "left_anti")
    return kept.select(index.columns).unionByName(delta.select(index.columns))
