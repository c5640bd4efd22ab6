"""N-gram Jaccard join against all pairs of shingle sets."""

import random
import re
from collections import Counter

import numpy as np

from recordlens.llm import ngram_join
from recordlens.llm.queries import op10_ngram_join

SCHEMA = "doc_id long, text string, node string, n int"
NAMES = ["doc_id", "n_shingles", "n_links", "class_id", "kept"]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs, threshold=0.8):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, links = {}, Counter()
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    common = Counter()
    for rows in holders.values():
        for x, i in enumerate(rows):
            for j in rows[x + 1 :]:
                common[i, j] += 1
    for (i, j), n in common.items():
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[max(root(i), root(j))] = min(root(i), root(j))
    key = lambda i: (docs[i][0] is None, docs[i][0] or 0, i)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for rows in groups.values():
        head = min(rows, key=key)
        out += [(docs[i][0], len(sets[i]), links[i], docs[head][0], i == head) for i in rows]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_whole_table_equals_brute_force(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert got(op10_ngram_join(spark, tables)) == brute(docs)


def near_copies(n, rng, words=120, vocabulary=400, edits=(0, 1, 1, 2, 4)):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.choice(edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(9999)}"
        out.append(" ".join(copy))
    return out


def test_dense_groups_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rng = random.Random(9)
    texts = near_copies(150, rng) + [t for _ in range(20) for t in near_copies(3, rng)] + near_copies(40, rng, edits=(0,))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + near_copies(1, rng)[0] for _ in range(60)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    want = brute(docs)
    assert got(ngram_join.classes(df)) == want
    kept = ngram_join.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if r[-1])


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    docs = [
        (None, None),
        (1, ""),
        (1, ""),
        (2, " \n\t"),
        (3, "one two"),
        (4, "one  two\n"),
        (5, "two one"),
        (6, "a b c d e f"),
        (6, "a b c d e f"),
        (None, "a b c d e f"),
        (7, long),
        (8, long + " tail"),
        (None, "only null ids here to see"),
        (None, "only null ids here to see"),
    ]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).coalesce(1)
    assert got(ngram_join.classes(df)) == brute(docs)
    assert ngram_join.classes(df.limit(0)).count() == 0
    assert ngram_join.drop_duplicates(df).count() == sum(r[-1] for r in brute(docs))


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64)) for _ in range(90)]
    common = ngram_join.common_counts(sets)
    for i in range(90):
        for j in range(i):
            assert common[i, j] == common[j, i] == len(np.intersect1d(sets[i], sets[j]))


def test_prefixes_are_shortened_until_the_recall():
    forest = ngram_join.Forest(16, 5, 0.8, 0.999)
    assert (forest.short, forest.shortened) == (4, 5) and forest.found(0.8) >= 0.999
    forest.shortened -= 1
    assert forest.found(0.8) < 0.999
    whole = ngram_join.Forest(16, 5, 0.8, 0.9)
    assert (whole.short, whole.shortened) == (5, 16)


def test_crowded_nodes_move_to_other_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    forest = ngram_join.Forest(16, 5, 0.8, 0.999)
    k = forest.shortened
    short = {n: [100 * t + n for t in range(16)] for n in range(12)}
    for n in range(8):
        short[n][0] = 7  # sets 0 to 7 crowd the first tree
    for n in (8, 0):
        short[n][k] = 9  # set 8 shares a node with set 0, in the tree that set 0 takes instead
    rows = [(n, [10_000 + 100 * t + n for t in range(16)], keys) for n, keys in short.items()]
    df = spark.createDataFrame(rows, "node long, long array<long>, short array<long>")
    found = {(r.node, r.tree): r.key for r in ngram_join._tree_nodes(df, forest, str(tmp_path)).collect()}
    assert len(found) == 12 * 16
    for n, keys in short.items():
        at = {t for t in range(16) if found[n, t] == keys[t]}
        assert all(found[n, t] == 10_000 + 100 * t + n for t in set(range(16)) - at)
        want = set(range(1, k + 1)) if n < 8 else set(range(k + 1)) if n == 8 else set(range(k))
        assert at == want


def test_crowds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 2)
    rng = random.Random(4)
    docs = list(enumerate(near_copies(60, rng) + [t for _ in range(30) for t in near_copies(3, rng)]))
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    assert got(ngram_join.classes(df)) == brute(docs)


def test_recall_of_the_forest_on_pairs_at_the_threshold():
    """Pairs just above 0.8 share a used prefix about as often as promised."""
    forest, rng = ngram_join.Forest(16, 5, 0.8, 0.999), np.random.default_rng(3)
    met = 0
    for _ in range(400):
        both, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        a, b = (forest.signature(np.concatenate([both, x])) for x in (one, two))
        far = forest.prefixes(a, forest.short) == forest.prefixes(b, forest.short)
        near = forest.prefixes(a, forest.short + 1) == forest.prefixes(b, forest.short + 1)
        met += bool(far[: forest.shortened].any() or near.any())
    assert met >= 0.99 * 400
