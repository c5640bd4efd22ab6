"""Merkle manifest of a dataset: one digest for all rows, a proof for each, and a check of rows that may have been altered.

A leaf is the SHA-256 of a row's fields, each as its length in UTF-8 bytes, a colon and its value, or ``-`` for null. The
leaves of a language, in the order of doc_id, form a tree with ``ARITY`` children a node; its root is the language's
subroot. The subroots, in the order of the languages, form a tree of the same kind, whose root stands for the dataset.
Digests enter other digests as lowercase hex text, and are stored as 32 bytes.

The trees are evaluated by time-forward processing. Every node has a label (tree, level, index), and a node's digest is
sent forward to the label of its parent, where it waits until that label's turn. The queue of waiting digests is external:
between rounds it is a table in the shared folder, ordered by label through the shuffle. In a round, a task takes the
messages of one block, ``ARITY ** DEPTH`` neighbours of one level, into a heap and runs it forward by ``DEPTH`` levels; only
the block's last digest goes back to the table. So a round leaves one row of 4,096, and no task or driver holds more than a
block. The reversed sweep starts at the root: each block gets the proof suffix of its last node, and hands each of its nodes
the siblings on its own levels and that suffix; at the leaves the suffix is complete, is hashed, and is used to fold the
leaf of the row as it is found to a root of its own.

Defined cases: a null language comes before all others, a null doc_id before all others of its language. Rows with equal
doc_id are ordered by their leaf; equal rows have equal digests, so their order changes nothing. A lone leaf is its own
subroot, a lone subroot the root; a leaf without siblings has the digest of the empty text as its proof. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordlens.operators.joins import spread_join
from recordlens.operators.ordering import with_positions
from recordlens.session import materialize, scratch_path

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY_BITS, DEPTH = 3, 4
BLOCK_BITS = ARITY_BITS * DEPTH
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def leaf(**changed: Column) -> Column:
    """Digest of a row, with the fields in ``changed`` instead of its own."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def lowered_where_sampled() -> Column:
    """The text as the audit finds it: lower-cased where 3 divides the checksum of the doc_id."""
    sampled = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(sampled, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def joined_digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def sweep_forward(first: int, digests: list[str], levels: int) -> list[list[str]]:
    """Digests of the nodes of each level above neighbours that begin at index ``first``, lowest level first."""
    queue = [((0, first + i), d) for i, d in enumerate(digests)]
    heapify(queue)
    rows: list[list[str]] = [[] for _ in range(levels + 1)]
    waiting: list[str] = []
    while queue:
        (level, index), digest = heappop(queue)
        rows[level].append(digest)
        if level == levels:
            continue
        parent = (level + 1, index >> ARITY_BITS)
        waiting.append(digest)
        following = queue[0][0] if queue else None
        if following is None or following[0] != level or following[1] >> ARITY_BITS != parent[1]:
            heappush(queue, (parent, joined_digest(waiting)))
            waiting = []
    return rows


def sweep_back(rows: list[list[str]], first: int, suffix: list[tuple]) -> list[list[tuple]]:
    """Per lowest node of :func:`sweep_forward` the siblings (before, after) of each level, its own level first."""
    paths = [suffix]
    for level in range(len(rows) - 2, -1, -1):
        row, begin = rows[level], first >> (ARITY_BITS * level)
        above, parents = [], begin >> ARITY_BITS
        for i in range(len(row)):
            parent = ((begin + i) >> ARITY_BITS) - parents
            low = max(0, ((parent + parents) << ARITY_BITS) - begin)
            high = ((parent + parents + 1) << ARITY_BITS) - begin
            own = ("".join(row[low:i]), "".join(row[i + 1 : high]))
            above.append([own, *paths[parent]])
        paths = above
    return paths


def _block() -> Column:
    return F.shiftright("index", BLOCK_BITS)


def _left_levels(round_: int) -> Column:
    """Levels that a tree of ``size`` nodes still has to climb in a round, at most a block's."""
    total = F.expr(f"size(filter(sequence(0, 20), x -> shiftleft(1L, {ARITY_BITS} * x) < size))")
    return F.greatest(F.lit(0), F.least(F.lit(DEPTH), total - DEPTH * round_))


def _rounds(largest: int) -> int:
    rounds = 1
    while largest > 1 << (BLOCK_BITS * rounds):
        rounds += 1
    return rounds


def _fold_block(table: pa.Table) -> pa.Table:
    table = table.sort_by("index")
    index, levels = table["index"].to_pylist(), table["levels"][0].as_py()
    rows = sweep_forward(index[0], [d.hex() for d in table["digest"].to_pylist()], levels)
    return pa.table(
        {
            "tree": table["tree"].slice(0, 1),
            "size": table["size"].slice(0, 1),
            "index": pa.array([index[0] >> BLOCK_BITS], pa.int64()),
            "digest": pa.array([bytes.fromhex(rows[-1][0])], pa.binary()),
        }
    )


NODE = "tree bigint, size bigint, index bigint, digest binary"


def climb(nodes: DataFrame, largest: int, folder: str) -> list[DataFrame]:
    """The stored nodes (tree, size, index, digest) of each round; the last round has one per tree, its root."""
    levels = [nodes]
    for round_ in range(_rounds(largest)):
        due = levels[-1].select("tree", "size", "index", "digest", _left_levels(round_).alias("levels"))
        folded = due.groupBy("tree", _block().alias("block")).applyInArrow(_fold_block, NODE)
        levels.append(materialize(folded, f"round-{round_ + 1}", folder))
    return levels


def _paths_of_block(nodes: pa.Table, above: pa.Table) -> tuple[pa.Table, list[list[tuple]]]:
    nodes = nodes.sort_by("index")
    first, levels = nodes["index"][0].as_py(), nodes["levels"][0].as_py()
    rows = sweep_forward(first, [d.hex() for d in nodes["digest"].to_pylist()], levels)
    suffix = [(s["before"], s["after"]) for s in above["path"][0].as_py()]
    return nodes, sweep_back(rows, first, suffix)


def _hand_down(nodes: pa.Table, above: pa.Table) -> pa.Table:
    nodes, paths = _paths_of_block(nodes, above)
    as_structs = [[{"before": b, "after": a} for b, a in path] for path in paths]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"tree": nodes["tree"], "index": nodes["index"], "path": pa.array(as_structs, kind)})


def descend(levels: list[DataFrame], top: DataFrame, folder: str) -> DataFrame:
    """(tree, index, path) of the blocks of the lowest round, from ``top`` with the paths of the trees' roots."""
    paths = top
    for round_ in range(len(levels) - 2, 0, -1):
        paths = materialize(_by_block(levels[round_], round_, paths).applyInArrow(
            _hand_down, f"tree bigint, index bigint, path {PATH}"
        ), f"paths-{round_}", folder)
    return paths


def _by_block(nodes: DataFrame, round_: int, paths: DataFrame):
    due = nodes.withColumns({"block": _block(), "levels": _left_levels(round_)})
    return due.groupBy("tree", "block").cogroup(
        paths.select("tree", F.col("index").alias("block"), "path").groupBy("tree", "block")
    )


def _fold(start: str, path: list[tuple]) -> str:
    for before, after in path:
        start = hashlib.sha256(f"{before}{start}{after}".encode()).hexdigest()
    return start


def _prove_block(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Leaves with the digest of their proof and the root that their row, as found, leads to."""
    nodes, paths = _paths_of_block(nodes, above)
    proofs, roots = [], []
    for found, path in zip(nodes["found"].to_pylist(), paths):
        proofs.append(joined_digest([s for level in path for s in level]))
        roots.append(_fold(found.hex(), path))
    return pa.table(
        {
            "tree": nodes["tree"],
            "doc_id": nodes["doc_id"],
            "leaf": nodes["digest"],
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(roots, pa.string()),
        }
    )


def manifest(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    ``found_text`` is the text that the check finds instead of the row's own.
    """
    found_text = F.col("text") if found_text is None else found_text
    folder = scratch_path(docs.sparkSession, "merkle")
    hashed = docs.select(
        "doc_id", "lang", leaf().alias("digest"), leaf(text=found_text).alias("found"), F.monotonically_increasing_id().alias("tie")
    )
    leaves = materialize(hashed, "leaves", folder)
    placed = with_positions(leaves, [F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("tie")], "index", "lang", folder)
    # Joins on the language go by a text that tells null from all values.
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    placed = materialize(placed.drop("tie").withColumn("lang_key", key), "placed", folder)
    sizes = materialize(placed.groupBy("lang", "lang_key").agg(F.count("*").alias("size")), "sizes", folder)
    trees = with_positions(sizes, [F.asc_nulls_first("lang")], "tree", folder=folder)
    trees = materialize(trees.drop("lang"), "trees", folder)
    largest, languages = trees.agg(F.max("size"), F.count("*")).first()
    nodes = spread_join(placed.drop("lang"), trees, ["lang_key"]).drop("lang_key")
    nodes = materialize(nodes, "nodes", folder)
    by_tree = climb(nodes, largest or 0, f"{folder}/leaves-up")
    subroots = by_tree[-1].select(
        F.lit(0).cast("bigint").alias("tree"), F.lit(languages).cast("bigint").alias("size"), F.col("tree").alias("index"), "digest"
    )
    over_trees = climb(materialize(subroots, "subroots", folder), languages, f"{folder}/trees-up")
    start = over_trees[-1].select("tree", "index", F.array().cast(PATH).alias("path"))
    # The paths of the blocks of the upper tree, handed down to its leaves, are those of the lower trees' roots.
    blocks = descend(over_trees, start, f"{folder}/trees-down")
    roots = _by_block(over_trees[0], 0, blocks).applyInArrow(_hand_down, f"tree bigint, index bigint, path {PATH}")
    roots = materialize(roots, "root-paths", folder).select(
        F.col("index").alias("tree"), F.lit(0).cast("bigint").alias("index"), "path"
    )
    blocks = descend(by_tree, roots, f"{folder}/leaves-down")
    proven = _by_block(nodes, 0, blocks).applyInArrow(
        _prove_block, f"tree bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf binary, proof_sha256 string, folded_root string"
    )
    root = over_trees[-1].select(F.lower(F.hex("digest")).alias("root"))
    ends = by_tree[-1].select("tree", F.lower(F.hex("digest")).alias("subroot")).join(F.broadcast(root))
    joined = spread_join(materialize(proven, "proven", folder), materialize(ends, "ends", folder), ["tree"])
    return joined.select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
