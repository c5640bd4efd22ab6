"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact sets decide.

Texts are sets of five-word shingles (words are runs of other than ASCII white space; a shorter text is one shingle
of all its words). Texts with one set are merged first and counted by weight.

1. Every set gets ``trees`` labels of ``depth`` minimum hashes; the labels of a tree are a prefix trie, kept as a table of the
   keys of its nodes and sorted by them, so that the sets of a node lie together. All sets start at a long prefix in every tree
   and shorten it, tree by tree, until a pair at the threshold is found with at least ``recall``: then the product of the
   trees' chances to miss it is small enough. A set shortens where the shorter prefix is not crowded, and in crowded
   nodes only if no other trees are left, the least crowded first. A node is used at its shorter prefix as soon as one of its
   sets asks for it, so every set keeps its recall whatever its partners choose; crowding is counted in powers of two
   above ``CROWD`` sets, so a single partner does not sway the choice.
2. Sets in one node are compared by their whole signatures, block against block; what cannot reach the threshold
   is left (``slack`` below it, over five standard deviations). Blocks emit one edge per row, never the pairs.
3. The connected groups are compared exactly, again in blocks: counts of common shingles over the sizes.

A node or group that holds a third of all rows becomes many tasks of at most two blocks each.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are kept. Repeated rows are copies: each
counts as a link of the others. ``class_id`` is the smallest doc_id of the group (null only if all are null), and exactly
one row per group is kept, the first by doc_id. Extra columns are ignored by the join and kept by ``drop_duplicates``; an
empty table gives an empty result. Texts are read whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordlens.llm.common import UID, block_components, fields, into_blocks, numbered, numbered_rows, runs
from recordlens.llm.components import components
from recordlens.operators.joins import spread_join
from recordlens.session import materialize, scratch_path

WORDS = 5
BLOCK = 1024
CROWD = 1024
MIX, PRIME = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
STEPS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(np.concatenate([[0], (~IS_SPACE[raw]).view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    ahead = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(ahead, length)
    place = (inside.astype(np.uint64) + np.uint64(1)) * PRIME
    each = _mixed(raw[inside + np.repeat(start, length)].astype(np.uint64) * MIX + place)
    return _mixed(np.add.reduceat(each, ahead) + length.astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        return _mixed((words * STEPS[:n]).sum(keepdims=True) + np.uint64(n))
    rolled = sum(words[k : n - WORDS + 1 + k] * STEPS[k] for k in range(WORDS))
    return np.unique(_mixed(rolled + np.uint64(WORDS)))


class Forest:
    """The two prefix lengths in use, and in how many trees a set takes the shorter one to reach the recall."""

    def __init__(self, trees: int, depth: int, threshold: float, recall: float, seed: int = 5):
        self.trees, self.depth = trees, depth
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.short, self.shortened = depth, trees
        while self.short > 1 and self.found(threshold) < recall:
            self.short -= 1
        while self.short < depth and self.shortened > 0:
            self.shortened -= 1
            if self.found(threshold) < recall:
                self.shortened += 1
                break

    def found(self, similarity: float) -> float:
        """Chance that a pair of this similarity shares a prefix in some tree."""
        missed = (1 - similarity**self.short) ** self.shortened
        return 1 - missed * (1 - similarity ** (self.short + 1)) ** (self.trees - self.shortened)

    def signature(self, found: np.ndarray) -> np.ndarray:
        """Minimum per hash function, 32 bits each."""
        least = np.full(len(self.factors), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(found), 4096):
            values = (found[at : at + 4096, None] * self.factors) >> np.uint64(32)
            least = np.minimum(least, values.min(axis=0).astype(np.uint32))
        return least

    def prefixes(self, signature: np.ndarray, length: int) -> np.ndarray:
        """One 64-bit key per tree for the first ``length`` hashes of its label."""
        labels = signature.reshape(self.trees, self.depth)[:, :length].astype(np.uint64)
        key = np.arange(1, self.trees + 1, dtype=np.uint64) + np.uint64(length * self.trees)
        for k in range(labels.shape[1]):
            key = _mixed(key * PRIME + labels[:, k])
        return key.view(np.int64)


def _signatures(forest: Forest):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, near, far, least = [], [], [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                signature = forest.signature(found)
                sizes.append(len(found))
                first.append(int(_mixed(found).sum().view(np.int64)))
                second.append(int(_mixed(found * PRIME + MIX).sum().view(np.int64)))
                near.append(forest.prefixes(signature, forest.short + 1))
                far.append(forest.prefixes(signature, forest.short))
                least.append(signature.astype(np.uint16).tobytes())
            offsets = pa.array(np.arange(len(sizes) + 1) * forest.trees, pa.int32())

            def lists(keys: list[np.ndarray]) -> pa.ListArray:
                flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
                return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    lists(near),
                    lists(far),
                    pa.array(least, pa.binary()),
                ],
                names=[UID, "doc_id", "n", "set1", "set2", "long", "short", "signature"],
            )

    return sign


EDGES = "node bigint, least bigint"


def _prefix_links(least_matches: int):
    """Within runs of one prefix and block pair: edges between sets whose signatures agree enough."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["tree", "key", "i", "j"]):
            node = table.column("node").to_numpy()
            raw = b"".join(table.column("signature").to_pylist())
            signature = np.frombuffer(raw, np.uint16).reshape(len(node), -1)
            near = np.empty((len(node), len(node)), bool)
            step = max(1, (1 << 22) // max(1, signature.size))
            for at in range(0, len(node), step):
                same = signature[at : at + step, None, :] == signature[None, :, :]
                near[at : at + step] = np.count_nonzero(same, axis=2) >= least_matches
            label = block_components(near, node)
            keep = label != node
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[keep], pa.int64()), pa.array(label[keep], pa.int64())], names=["node", "least"]
                )

    return link


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, as a matrix (the diagonal is not filled)."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    often = np.diff(np.append(starts, len(value)))
    frequency = np.repeat(often, often)
    common = np.zeros(m * m, np.int64)
    rare = 32
    for apart in range(1, min(rare, m)):  # elements of few sets: pairs of neighbours in the sorted list
        a = np.flatnonzero((value[apart:] == value[:-apart]) & (frequency[apart:] <= rare))
        common += np.bincount(owner[a] * m + owner[a + apart], minlength=m * m) if len(a) else 0
    common = common.reshape(m, m)
    common = common + common.T
    column = np.cumsum(often > rare) - 1
    wide = np.flatnonzero(often > rare)
    for at in range(0, len(wide), 4096):  # elements of many sets: a product of incidence matrices
        incidence = np.zeros((m, min(4096, len(wide) - at)), np.float32)
        group = np.repeat(np.arange(len(often)), often)
        mine = (frequency > rare) & (column[group] >= at) & (column[group] < at + 4096)
        incidence[owner[mine], column[group[mine]] - at] = 1
        common += np.rint(incidence @ incidence.T).astype(np.int64)
    return common


def _exact_links(threshold: float):
    """Within runs of one group and block pair: exact links, as counts and edges."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["component", "i", "j"]):
            node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
            weight = table.column("weight").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("found").to_pylist()]
            size = np.array([len(s) for s in sets])
            common = common_counts(sets)
            near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
            np.fill_diagonal(near, False)
            if table.column("i")[0].as_py() != table.column("j")[0].as_py():
                near &= own[:, None] != own[None, :]  # pairs within one block are other tasks
            keep = near.any(axis=1)
            if keep.any():
                label = block_components(near, node)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[keep], pa.int64()),
                        pa.array(label[keep], pa.int64()),
                        pa.array((near @ weight)[keep], pa.int64()),
                    ],
                    names=["node", "least", "links"],
                )

    return link


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(text.as_py()).tobytes() for text in batch.column("text")]
        names = ["node", "component", "weight"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(found, pa.binary())], names=[*names, "found"]
        )


def _tree_nodes(labelled: DataFrame, forest: Forest, folder: str) -> DataFrame:
    """(node, tree, key): the prefix under which every set is compared in every tree."""
    prefix = ["tree", "short"]
    labels = labelled.select("node", F.posexplode(F.arrays_zip("long", "short")).alias("tree", "label"))
    labels = labels.select("node", "tree", "label.long", "label.short")
    crowds = labels.groupBy(*prefix).agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    crowds = materialize(crowds.select(*prefix, F.floor(F.log2("n")).cast("int").alias("crowd")), "crowds", folder)
    # Sets outside of crowds shorten the first trees. Those inside choose: at most ``trees`` entries a set.
    inside = spread_join(labels.select("node", *prefix), crowds, prefix).groupBy("node")
    inside = inside.agg(F.map_from_entries(F.collect_list(F.struct("tree", "crowd"))).alias("crowds"))
    every = F.sequence(F.lit(0), F.lit(forest.trees - 1))
    order = F.transform(every, lambda t: F.struct(F.coalesce(F.col("crowds")[t], F.lit(0)).alias("crowd"), t.alias("tree")))
    chosen = inside.select("node", F.explode(F.slice(F.array_sort(order), 1, forest.shortened)).alias("c")).select("node", "c.*")
    chosen = chosen.where((F.col("tree") >= forest.shortened) | (F.col("crowd") > 0))
    asked = labelled.select("node", "short").join(chosen, "node")
    asked = asked.select("tree", F.element_at("short", F.col("tree") + 1).alias("short"), F.lit(True).alias("shorten"))
    other = crowds.select(*prefix, F.lit(False).alias("shorten")).unionByName(asked)
    other = materialize(other.groupBy(*prefix).agg(F.max("shorten").alias("shorten")), "asked", folder)
    shorten = F.coalesce("shorten", F.col("tree") < forest.shortened)
    key = F.when(shorten, F.col("short")).otherwise(F.col("long"))
    return spread_join(labels, other, prefix, "left").select("node", "tree", key.alias("key"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """uid, doc_id, n_shingles, n_links, class_id, kept for every row of ``docs`` (doc_id, text)."""
    folder = scratch_path(docs.sparkSession, "ngrams")
    return _classes(numbered(docs.select("doc_id", "text"), folder), folder, **options)


def _classes(
    rows: DataFrame,
    folder: str,
    threshold: float = 0.8,
    trees: int = 16,
    depth: int = 5,
    recall: float = 0.999,
    slack: float = 0.25,
) -> DataFrame:
    """The classes of numbered rows, written below ``folder``."""
    forest = Forest(trees, depth, threshold, recall)
    rows = rows.select(UID, F.col("doc_id").cast("long"), "text")
    signed = rows.select(UID, "doc_id", "text").mapInArrow(
        _signatures(forest),
        f"{UID} bigint, doc_id bigint, n bigint, set1 bigint, set2 bigint, "
        "long array<bigint>, short array<bigint>, signature binary",
    )
    signed = materialize(signed, "signed", folder)
    same = ["n", "set1", "set2"]
    sets = materialize(
        signed.where("n > 0")
        .groupBy(*same)
        .agg(F.min(UID).alias("node"), F.count("*").alias("weight")),
        "sets",
        folder,
    )
    labelled = signed.join(sets.select(F.col("node").alias(UID)), UID).select(F.col(UID).alias("node"), "long", "short", "signature")
    labelled = materialize(labelled, "labelled", folder)
    placed = into_blocks(_tree_nodes(labelled, forest, folder), ["tree", "key"], BLOCK).drop("own")
    order = ["tree", "key", "i", "j"]
    candidates = (
        placed.join(labelled.select("node", "signature"), "node")
        .select(*order, "node", "signature")
        .repartition(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_prefix_links(int((threshold - slack) * trees * depth)), EDGES)
    )
    groups = components(candidates.select(F.col("node").alias("a"), F.col("least").alias("b")))
    members = groups.join(sets.select("node", "weight"), "node")
    texts = rows.select(F.col(UID).alias("node"), "text").join(members, "node").select("node", "component", "weight", "text")
    found = materialize(texts.mapInArrow(_sets, "node bigint, component bigint, weight bigint, found binary"), "found", folder)
    order = ["component", "i", "j"]
    exact = (
        into_blocks(found.select("node", "component"), ["component"], BLOCK)
        .join(found.drop("component"), "node")
        .select(*order, "own", "node", "weight", "found")
        .repartition(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_exact_links(threshold), EDGES + ", links bigint")
    )
    exact = materialize(exact, "exact", folder)
    linked = components(exact.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    by_set = (
        sets.join(links, "node", "left")
        .join(linked, "node", "left")
        .select(
            *same,
            F.coalesce("component", "node").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
    )
    judged = signed.select(UID, "doc_id", *same).join(by_set, same, "left")
    judged = judged.withColumn("component", F.coalesce("component", F.col(UID)))
    judged = materialize(judged.select(UID, "doc_id", "n", "component", "n_links"), "judged", folder)
    last = F.lit(2**63 - 1)
    heads = judged.groupBy("component").agg(
        F.min("doc_id").alias("class_id"), F.min(F.coalesce("doc_id", last)).alias("head")
    )
    first = (
        judged.join(heads, "component")
        .where(F.coalesce("doc_id", last) == F.col("head"))
        .groupBy("component")
        .agg(F.min(UID).alias("first_uid"))
    )
    return judged.join(heads.join(first, "component"), "component").select(
        UID,
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "class_id",
        (F.col(UID) == F.col("first_uid")).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies; same columns."""
    folder = scratch_path(docs.sparkSession, "ngrams")
    rows = numbered_rows(docs, folder)
    gone = _classes(fields(rows, "doc_id", "text"), folder, **options).where("not kept").select(UID)
    return rows.join(gone, UID, "left_anti").select("row.*")
