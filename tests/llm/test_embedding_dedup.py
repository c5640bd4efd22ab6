"""Near-duplicate vectors against all pairs in numpy."""

import numpy as np

from recordlens.llm import embedding_dedup
from recordlens.llm.queries import op3_embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, key string, node int"
NAMES = ["vec_id", "n_links", "component_id", "kept"]


def brute(rows, threshold=0.98):
    """Rows (vec_id, embedding, label) with distinct ids."""
    ok = [
        label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v, label in rows
    ]
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if o else None for (_, v, _), o in zip(rows, ok)]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    groups = {}
    for i, (_, v, label) in enumerate(rows):
        if ok[i]:
            groups.setdefault((label, len(v)), []).append(i)
    for members in groups.values():
        near = np.array([unit[i] for i in members]) @ np.array([unit[i] for i in members]).T >= threshold
        for a, b in zip(*np.nonzero(np.triu(near, 1))):
            i, j = members[a], members[b]
            links[i] += 1
            links[j] += 1
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        least[root(i)] = min(vec, least.get(root(i), vec))
    return sorted((vec, links[i], least[root(i)], vec == least[root(i)]) for i, (vec, _, _) in enumerate(rows))


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_whole_table_equals_brute_force(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(op3_embedding_dedup(spark, tables)) == sorted(brute(rows), key=repr)


def test_dense_groups_over_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    rng = np.random.default_rng(3)
    vectors = []
    for size, noise in ((400, 0.028), (150, 0.02), (60, 0.0)):
        base = rng.normal(size=16)
        vectors += [base / np.linalg.norm(base) * 3 + noise * 3 * rng.normal(size=16) for _ in range(size)]
    vectors += list(rng.normal(size=(200, 16)))
    rows = [(i, [float(x) for x in np.float32(v)], i % 2) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(7)
    result = embedding_dedup.near_duplicates(df, per_cell=25)
    want = brute(rows)
    assert got(result) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 10_000


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0]
    rows = [
        (1, None, 1),
        (2, [], 1),
        (3, [0.0, 0.0], 1),
        (4, [nan, 1.0], 1),
        (5, [inf, 1.0], 1),
        (6, [None, 1.0], 1),
        (7, one, None),
        (8, one, 1),
        (9, [2.0, 0.0], 1),
        (10, one, 2),
        (11, [1.0, 0.0, 0.0], 1),
        (12, [1e-30, 0.0], 1),
        (13, [3e38, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(embedding_dedup.near_duplicates(df)) == sorted(brute(rows), key=repr)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    again = spark.createDataFrame([(8, one, 1, "x", 1), (8, one, 1, "x", 1), (None, one, 1, "x", 1)], SCHEMA)
    assert got(embedding_dedup.near_duplicates(again)) == [(8, 2, 8, True), (8, 2, 8, True), (None, 2, 8, False)]
