"""Connected components against union-find."""

import random

from recordlens.llm.components import components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    sizes = {}
    for x in parent:
        sizes.setdefault(root(x), []).append(x)
    return sorted((x, r) for r, xs in sizes.items() if len(xs) > 1 for x in xs)


def check(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(tuple(r) for r in components(df).collect()) == brute([e for e in edges if e[0] != e[1]])


def test_random_graph_chain_and_star(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    rng.shuffle(edges)
    check(spark, edges)


def test_empty(spark):
    check(spark, [])
