"""Source divergence audit: how far the word counts of every source lie from those of the other sources of its language.

A document's terms are its runs of letters (ASCII letters in lower case, and every character beyond ASCII). A language keeps
the terms that at least ``least_docs`` of its documents hold; V is their number. A group is a (lang, source) that occurs.
For a group, or a language as a whole, with N occurrences of kept terms, a term of count c has the smoothed share
p = 1 + floor(10**9 (c + 1) / (N + V)), and the distance of two shares is f(p, q) = floor((p - q)**2 / q).

1. Tasks count the terms of blocks of texts by sorting their numbers and write one row for each language and bucket of
   terms (a hash), with its terms and counts as arrays. Spark brings the rows of a bucket together, where they are added up.
2. Per language, terms with the same count in every group become one row with their number, so that a count vector which
   a third of all terms share is one row. The rows are sorted by their vectors: this is the order of the vocabulary, in
   which equal counts lie together. It is cut into segments of ``SEGMENT`` rows, the unit of distribution.
3. In a segment each group's column is run-length encoded. For two groups the boundaries of their runs are intersected;
   f is taken once for each piece and multiplied by its length. Sums per segment are added up by Spark.

All numbers are integers: shares come from 64 bits, or decimals for large counts, in the JVM and from Python integers in tasks, distances fit 64 bits
as shares are at most 10**9 + 1. The rows of the pair part are as many as the ordered pairs of sources of a language.

Defined cases: null text, lang and source are the empty text. A group without terms has rows all the same; in a language
without kept terms every pair has the value 0. Repeated rows are documents of their own. Extra columns are ignored. An
empty table gives an empty result. Long texts are read in slices, so only their distinct terms are held.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from recordlens.llm.common import runs
from recordlens.operators.joins import small_side
from recordlens.operators.ordering import with_positions
from recordlens.session import materialize, scratch_path

SCALE = 10**9
SEGMENT = 4096
SLICE = 1 << 20
HELD_BYTES, HELD_ROWS = 1 << 23, 1 << 16
LEAST_BUCKETS = 1024
SPREAD = 64
# Counts below this times SCALE fit 64 bits.
SHORT = 9 * 10**9
PACKED = "bucket int, lang string, sources array<string>, terms binary, lengths binary, docs binary, many binary, place binary, n binary"
# A byte of a term as it counts; all others end a term.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about a slice."""
    spaced = raw.translate(TERM_BYTES)
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + SLICE)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def terms_in(texts: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms of the texts in order, and for each the number of its text."""
    offsets = _offsets(texts)
    raw = np.frombuffer(_bytes(texts).tobytes().translate(TERM_BYTES), np.uint8)
    begins, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    inside = raw != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A term ends with its text, whatever the next one begins with.
    begins, before = begins[begins < len(raw)], ends[ends > 0] - 1
    first[begins], last[before] = inside[begins], inside[before]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets - offsets[0])))
    return _binaries(lengths, raw[inside]), text


def _offsets(column: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def _bytes(column: pa.LargeBinaryArray) -> np.ndarray:
    """The bytes of all values, one after the other."""
    offsets, data = _offsets(column), column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)


def _binaries(lengths: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.binary()).cast(pa.large_binary())


def _strings(values: pa.LargeBinaryArray) -> pa.StringArray:
    return values.cast(pa.binary()).view(pa.string())


def _codes(values: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The distinct values, sorted by their bytes, and the number of each value among them."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def _first(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = _first(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def _bucket_of(terms: pa.LargeBinaryArray, buckets: int) -> np.ndarray:
    return np.fromiter(map(crc32, terms.to_pylist()), np.int64, len(terms)) % buckets


def _count_block(lang: pa.Array, source: pa.Array, texts: pa.LargeBinaryArray, buckets: int) -> pa.RecordBatch:
    """Texts to packed rows, counted by sorting numbers; each text also has the empty term once."""
    langs, lang = _codes(lang)
    sources, source = _codes(source)
    found, text = terms_in(texts)
    found = pa.concat_arrays([found, pa.array([b""] * len(texts), pa.large_binary())]).dictionary_encode()
    text = np.concatenate([text, np.arange(len(texts))])
    bucket = _bucket_of(found.dictionary, buckets)
    order = np.argsort(bucket, kind="stable")  # numbers terms so that those of a bucket are neighbours
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term = place[found.indices.to_numpy()]
    # Pairs of numbers are one number, shifted by bits, as division takes longer.
    wide, many_sources = len(order).bit_length(), len(sources).bit_length()
    entries, n = _counted((lang[text] << wide | term) << many_sources | source[text])
    pairs, _ = _counted(text << wide | term)
    terms, docs = _counted(lang[pairs >> wide] << wide | pairs & (1 << wide) - 1)
    own = order[terms & (1 << wide) - 1]
    of_term, source = entries >> many_sources, entries & (1 << many_sources) - 1
    many = np.diff(np.append(_first(of_term), len(entries)))
    return _packed(langs, sources, terms >> wide, bucket[own], found.dictionary.take(own), docs, many, source, n)


def _count_long(lang: bytes, source: bytes, text: bytes, buckets: int) -> pa.RecordBatch:
    """One long text to packed rows, in slices, so that only its distinct terms are held."""
    counts = Counter({b"": 1})
    for part in terms_of(text):
        counts.update(part)
    terms = pa.array(list(counts), pa.large_binary())
    bucket = _bucket_of(terms, buckets)
    order = np.argsort(bucket, kind="stable")
    n = np.fromiter(counts.values(), np.int64, len(counts))[order]
    one, zero = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    langs, sources = (pa.array([name], pa.large_binary()) for name in (lang, source))
    return _packed(langs, sources, zero, bucket[order], terms.take(order), one, one, zero, n)


def _packed(langs, sources, lang, bucket, terms, docs, many, source, n) -> pa.RecordBatch:
    """One row for each lang and bucket with its terms: their bytes and lengths, documents, number of entries, and for
    each entry (a source of the term) its place in ``sources`` of the row and its count, as arrays of integers.

    ``lang``, ``bucket``, ``docs`` and ``many`` are per term, sorted by lang and bucket; ``source`` and ``n`` per entry.
    """
    first = _first(lang * (bucket.max(initial=0) + 1) + bucket)
    cuts = np.append(first, len(terms))
    entry_cuts = np.concatenate([[0], np.cumsum(many)])[cuts]
    offsets = _offsets(terms)
    in_row = np.repeat(np.arange(len(first)), np.diff(entry_cuts)) * len(sources) + source
    there, _ = _counted(in_row)
    source_cuts = np.searchsorted(there, np.arange(len(first) + 1) * len(sources))
    source = np.searchsorted(there, in_row) - np.repeat(source_cuts[:-1], np.diff(entry_cuts))

    def blobs(values: np.ndarray, kind: type, at: np.ndarray) -> pa.Array:
        values = values.astype(kind)
        return _binaries(np.diff(at) * values.itemsize, values.view(np.uint8)).cast(pa.binary())

    columns = [
        pa.array(bucket[first], pa.int32()),
        _strings(langs.take(lang[first])),
        pa.ListArray.from_arrays(pa.array(source_cuts, pa.int32()), _strings(sources.take(there % len(sources)))),
        _binaries(np.diff(offsets[cuts]), _bytes(terms)).cast(pa.binary()),
        blobs(np.diff(offsets), np.int32, cuts),
        blobs(docs, np.int64, cuts),
        blobs(many, np.int32, cuts),
        blobs(source, np.int32, entry_cuts),
        blobs(n, np.int64, entry_cuts),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in PACKED.split(", ")])


def _count_terms(buckets: int):
    """Rows (lang, source, text) to packed rows, for blocks of about ``HELD_BYTES`` of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []
        rows = size = 0
        for batch in (b.slice(at, HELD_ROWS) for b in batches for at in range(0, b.num_rows, HELD_ROWS)):
            columns = [_plain(column) for column in batch.columns]
            long = np.diff(_offsets(columns[2])) > SLICE
            if long.any():
                for row in zip(*(column.filter(pa.array(long)) for column in columns)):
                    yield _count_long(*(value.as_py() for value in row), buckets)
                columns = [column.filter(pa.array(~long)) for column in columns]
            held.append(columns)
            rows += len(columns[2])
            size += len(_bytes(columns[2]))
            if size >= HELD_BYTES or rows >= HELD_ROWS:
                yield _count_block(*(pa.concat_arrays(c) for c in zip(*held)), buckets)
                held, rows, size = [], 0, 0
        if rows:
            yield _count_block(*(pa.concat_arrays(c) for c in zip(*held)), buckets)

    return count


def _add_up(least_docs: int):
    """Packed rows sorted by bucket to (lang, term, total, by_source) of the kept terms."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["bucket"]):
            yield _kept_terms(table, least_docs)

    return add


def _kept_terms(rows: pa.Table, least_docs: int) -> pa.RecordBatch:
    def numbers(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        column = _plain(rows[name])
        return _bytes(column).copy().view(kind).astype(np.int64), np.diff(_offsets(column)) // np.dtype(kind).itemsize

    (lengths, per_row), (docs, _), (many, _) = numbers("lengths", np.int32), numbers("docs", np.int64), numbers("many", np.int32)
    (place, entries_per_row), (n, _) = numbers("place", np.int32), numbers("n", np.int64)
    langs, lang = _codes(_plain(rows["lang"]))
    listed = rows["sources"].combine_chunks()
    sources, source = _codes(_plain(listed.flatten()))
    begins = np.cumsum(sizes := pc.list_value_length(listed).to_numpy()) - sizes
    source = source[place + np.repeat(begins, entries_per_row)]
    terms = _binaries(lengths, _bytes(_plain(rows["terms"]))).dictionary_encode()
    kinds = len(terms.dictionary)
    term = np.repeat(lang, per_row) * kinds + terms.indices.to_numpy()
    order = np.argsort(term)
    first = _first(term[order])
    own = term[order][first]
    empty = pc.binary_length(terms.dictionary).to_numpy()[own % kinds] == 0
    kept = own[empty | (np.add.reduceat(docs[order], first) >= least_docs)]
    # Entries of other terms are gone before they are sorted.
    at = np.minimum(np.searchsorted(kept, of := np.repeat(term, many)), max(len(kept) - 1, 0))
    wanted = kept[at] == of if len(kept) else np.zeros(len(of), bool)
    key = at[wanted] * len(sources) + source[wanted]
    order = np.argsort(key)
    first = _first(key[order])
    key, n = key[order][first], np.add.reduceat(n[wanted][order], first) if len(first) else n[:0]
    cuts = np.searchsorted(key, np.arange(len(kept) + 1) * len(sources))
    total = np.add.reduceat(n, cuts[:-1]) if len(kept) else n[:0]
    by_source = pa.StructArray.from_arrays([_strings(sources.take(key % len(sources))), pa.array(n)], names=["source", "n"])
    return pa.RecordBatch.from_arrays(
        [
            _strings(langs.take(kept // kinds)),
            _strings(terms.dictionary.take(kept % kinds)),
            pa.array(total),
            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), by_source),
        ],
        names=["lang", "term", "total", "by_source"],
    )


def packed_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts of every task as packed rows, one for each block of texts, lang and bucket of terms."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(_count_terms(buckets), PACKED)


def vocabulary(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, term, total, by_source): kept terms with their counts per source, at most one entry for each.

    The empty term is there for every language, with all its sources.
    """
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        packed_counts(docs, buckets)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_add_up(least_docs), "lang string, term string, total bigint, by_source array<struct<source:string,n:bigint>>")
    )


def group_sizes(found: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, v): N of every occurring group, N and V of its language."""
    kept = found.where("term <> ''")
    groups = found.where("term = ''").select("lang", F.inline("by_source")).select("lang", "source")
    own = kept.select("lang", F.inline("by_source")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    whole = kept.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count("*").alias("v"))
    joined = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    return joined.na.fill(0, ["size", "lang_size", "v"])


def share(count: Column, size: Column, v: Column) -> Column:
    """p of a count, exact at any size."""
    scaled = (count.cast("decimal(19,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    wide = F.call_function("div", scaled, (size + v).cast("decimal(20,0)"))
    short = F.call_function("div", (count + 1) * SCALE, size + v)
    return F.when(count < SHORT, short).otherwise(wide) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def run_lengths(column: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of equal counts; the rows of the column begin at ``begins`` in the vocabulary."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1])
    return begins[first], column[first]


def shares_of(counts: np.ndarray, size: int, v: int) -> np.ndarray:
    distinct, place = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (c + 1) // (size + v) for c in distinct.tolist()], np.int64)[place]


def intersected(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], total: int) -> tuple[int, int]:
    """Sums of f(a, b) and f(b, a) over a stretch of ``total`` terms, from the runs (starts, shares) of both."""
    starts = np.union1d(a[0], b[0])
    length = np.diff(np.append(starts, total))
    p = a[1][np.searchsorted(a[0], starts, "right") - 1]
    q = b[1][np.searchsorted(b[0], starts, "right") - 1]
    square = (p - q) ** 2
    return int((square // q * length).sum()), int((square // p * length).sum())


def _segment_pairs(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of all pairs of sources in one segment of one language's vocabulary."""
    rows = rows.sort_by("position")
    sources = groups["source"].to_pylist()
    length = rows["length"].to_numpy()
    total = int(length.sum())
    begins = np.cumsum(length) - length
    runs = []
    if total:
        entries = rows["by_source"].combine_chunks()
        flat = entries.flatten()
        of_row = np.repeat(np.arange(len(length)), np.diff(entries.offsets.to_numpy()))
        of_source = flat.field("source").dictionary_encode()
        number = {s: i for i, s in enumerate(sources)}
        to_group = np.array([number[s] for s in of_source.dictionary.to_pylist()])
        group, n = to_group[of_source.indices.to_numpy()], flat.field("n").to_numpy()
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(sources) + 1))
        for i, (size, v) in enumerate(zip(groups["size"].to_pylist(), groups["v"].to_pylist())):
            column = np.zeros(len(length), np.int64)
            mine = order[cuts[i] : cuts[i + 1]]
            column[of_row[mine]] = n[mine]
            starts, counts = run_lengths(column, begins)
            runs.append((starts, shares_of(counts, size, v)))
    source, item, value = [], [], []
    for i in range(len(sources)):
        for j in range(i):
            there, back = intersected(runs[i], runs[j], total) if total else (0, 0)
            source += (sources[i], sources[j])
            item += (sources[j], sources[i])
            value += (there, back)
    lang = groups["lang"][0].as_py() if groups.num_rows else ""
    return pa.table(
        {
            "lang": pa.array([lang] * len(value), pa.string()),
            "source": pa.array(source, pa.string()),
            "item": pa.array(item, pa.string()),
            "value": pa.array(value, pa.int64()),
        }
    )


def pair_distances(kept: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """(lang, source, item, value): for every ordered pair of sources of a language, f summed over the vocabulary."""
    vectors = materialize(
        kept.groupBy("lang", "by_source").agg(F.count("*").alias("length")), "vectors", folder
    )
    placed = with_positions(vectors, [F.asc("by_source")], group="lang", folder=folder)
    segments = materialize(placed.withColumn("segment", F.floor(F.col("position") / SEGMENT)), "segments", folder)
    last = segments.groupBy("lang").agg(F.max("segment").alias("last"))
    # A language without kept terms has one empty segment, which gives its pairs the value 0.
    everywhere = groups.join(last, "lang", "left").withColumn(
        "segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("last", F.lit(0).cast("bigint"))))
    )
    partial = (
        segments.groupBy("lang", "segment")
        .cogroup(everywhere.select("lang", "segment", "source", "size", "v").groupBy("lang", "segment"))
        .applyInArrow(_segment_pairs, "lang string, source string, item string, value bigint")
    )
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_distances(kept: DataFrame, groups: DataFrame, most: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): the ``most`` terms of each group that lie furthest above its language."""
    rows = kept.select("lang", F.col("term").alias("item"), "total", F.inline("by_source"))
    sized = rows.join(small_side(groups), ["lang", "source"])
    p, q = share(F.col("n"), F.col("size"), F.col("v")), share(F.col("total"), F.col("lang_size"), F.col("v"))
    shares = sized.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
    valued = shares.select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    # Two steps, so that the terms of a large group never gather in one task.
    order = (F.desc("value"), F.asc("item"))
    salt = F.pmod(F.xxhash64("item"), F.lit(SPREAD))
    within = Window.partitionBy("lang", "source", "salt").orderBy(*order)
    best = valued.withColumn("salt", salt).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= most)
    ranked = best.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` against each other source, part ``term`` against the language."""
    folder = scratch_path(docs.sparkSession, "divergence")
    found = materialize(vocabulary(docs, least_docs), "found", folder)
    kept = found.where("term <> ''")
    groups = materialize(group_sizes(found), "groups", folder)
    others = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_distances(kept, groups, folder).withColumn("rank", F.row_number().over(others))
    terms = term_distances(kept, groups, most_terms)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(*columns)
    )
