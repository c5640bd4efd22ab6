"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one vector kept per group.

Only vectors with equal, non-null labels (and equal length) are compared. Copies of one vector are merged first and
counted by weight. The centres are fitted on a bounded sample; every vector then has one home cell and visits
every other cell whose border lies within half the chord of the threshold. Of two vectors at or above the
threshold in different cells, at least one visits the other's home, so the search is exact, whatever the sample.

A cell is cut into blocks; each pair of blocks is one task's matrix product. It emits a count per row and
one edge per row, never the pairs, so a cell that holds a third of all rows is many equal tasks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label,
link with nothing and are kept. Repeated rows count as copies; rows of one id share what is said about it. A
null id is allowed and never names a group of known ids. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordlens.llm.common import UID, block_components, into_blocks, with_uid
from recordlens.llm.components import components
from recordlens.session import materialize, scratch_path

BLOCK = 2048


def unit_rows(vectors) -> np.ndarray:
    """Double-precision unit vectors as a matrix."""
    matrix = np.asarray(vectors, np.float64)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres; empty cells keep their centre."""
    picks = np.random.default_rng(seed).permutation(len(sample))[:k]
    centres = sample[np.sort(picks)]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return np.unique(centres, axis=0)


def fit_centres(groups: DataFrame, per_cell: int, sample_rows: int, most_cells: int) -> dict[int, np.ndarray]:
    """Centres per vector length, from at most ``sample_rows`` vectors of each length."""
    centres = {}
    for row in groups.groupBy("dim").agg(F.count("*").alias("n")).collect():
        sample = groups.where(F.col("dim") == row.dim).orderBy("key").limit(sample_rows).select("embedding").toArrow()
        vectors = unit_rows(np.stack(sample.column(0).to_numpy(zero_copy_only=False)))
        cells = min(most_cells, math.ceil(row.n / per_cell), len(vectors))
        centres[row.dim] = spherical_kmeans(vectors, cells)
    return centres


def assign_cells(groups: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """One row per vector and cell it takes part in: home, visits (all cells but home), cell."""
    shared = groups.sparkSession.sparkContext.broadcast(centres)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-9
    schema = "node bigint, weight bigint, label string, dim int, embedding array<double>, home int, visits array<int>, cell int"

    def assign(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = unit_rows(np.stack(part.column("embedding").to_numpy(zero_copy_only=False)))
                cells = shared.value[int(dim)]
                near = unit @ cells.T
                home = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * cells @ cells.T, 1e-300))
                margin = (near[np.arange(len(unit)), home][:, None] - near) / apart[home]
                margin[np.arange(len(unit)), home] = np.inf
                row, visit = np.nonzero(margin <= reach)
                ends = np.searchsorted(row, np.arange(len(unit) + 1))
                visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(visit, pa.int32()))
                at = np.concatenate([np.arange(len(unit)), row])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node").take(pa.array(at)),
                        part.column("weight").take(pa.array(at)),
                        part.column("label").take(pa.array(at)),
                        part.column("dim").take(pa.array(at)),
                        pa.FixedSizeListArray.from_arrays(unit[at].ravel(), int(dim)).cast(pa.list_(pa.float64())),
                        pa.array(home[at], pa.int32()),
                        visits.take(pa.array(at)),
                        pa.array(np.concatenate([home, visit]), pa.int32()),
                    ],
                    names=["node", "weight", "label", "dim", "embedding", "home", "visits", "cell"],
                )

    return groups.select("node", "weight", "label", "dim", "embedding").mapInArrow(assign, schema)


def _compare(threshold: float):
    def compare(_key, table):
        node = table.column("node").to_numpy()
        own = table.column("own").to_numpy()
        order = np.argsort(own, kind="stable")
        table, node, own = table.take(pa.array(order)), node[order], own[order]
        weight = table.column("weight").to_numpy()
        home = table.column("home").to_numpy()
        cell = int(table.column("cell")[0].as_py())
        unit = np.stack(table.column("embedding").to_numpy(zero_copy_only=False))
        lists = table.column("visits").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        cells = int(max(home.max(), flat.max(initial=0), cell)) + 1
        visits = np.zeros((len(node), cells), bool)
        visits[owner, flat] = True
        inner = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        link = unit @ unit.T >= threshold
        np.fill_diagonal(link, False)
        if not inner:  # only pairs across the two blocks; those within are other tasks
            link &= own[:, None] != own[None, :]
        # A pair in two homes is judged in the smaller home, or in the other when only that one holds both.
        at_home = home == cell
        once = at_home[:, None] & (at_home[None, :] | (cell < home)[None, :] | ~visits[:, home])
        link &= once | once.T
        keep = link.any(axis=1)
        label = block_components(link, node)
        return pa.table(
            {
                "node": pa.array(node[keep], pa.int64()),
                "links": pa.array((link @ weight.astype(np.float64)).astype(np.int64)[keep], pa.int64()),
                "least": pa.array(label[keep], pa.int64()),
            }
        )

    return compare


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    per_cell: int = 4000,
    sample_rows: int = 20_000,
    most_cells: int = 2048,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    folder = scratch_path(spark, "vectors")
    fine = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    text = F.concat_ws("|", F.col("label").cast("string"), F.col("embedding").cast("string"))
    rows = with_uid(vectors.select("vec_id", "label", "embedding")).withColumn(
        "key", F.when(F.coalesce(fine, F.lit(False)), F.sha2(text, 256))
    )
    groups = materialize(
        rows.where("key is not null")
        .groupBy("key", F.col("label").cast("string").alias("label"), "embedding")
        .agg(F.min(UID).alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
        .withColumn("dim", F.size("embedding")),
        "groups",
        folder,
    )
    centres = fit_centres(groups, per_cell, sample_rows, most_cells)
    members = materialize(assign_cells(groups, centres, threshold), "members", folder)
    found = (
        into_blocks(members, ["label", "dim", "cell"], BLOCK)
        .groupBy("label", "dim", "cell", "i", "j")
        .applyInArrow(_compare(threshold), "node bigint, links bigint, least bigint")
    )
    found = materialize(found, "found", folder)
    linked = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    judged = (
        groups.select("key", "node", "weight", "least_id")
        .join(links, "node", "left")
        .join(linked, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    judged = materialize(judged, "judged", folder)
    names = judged.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_key = judged.join(names, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "key").join(by_key, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.col("vec_id").isNull() & component.isNull()).alias("kept"),
    )
