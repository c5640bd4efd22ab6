"""Merkle manifest against a plain recursive tree."""

import hashlib
import zlib

from recordlens.llm import merkle_manifest
from recordlens.llm.queries import op13_merkle_manifest

NAMES = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
FIELDS = "doc_id source lang n_chars text".split()
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """Root, and per leaf the (before, after) siblings of every level."""
    paths, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + 8] for i in range(0, len(digests), 8)]
        for path, p in zip(paths, place):
            run = runs[p // 8]
            path.append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        place = [p // 8 for p in place]
        digests = [h(*run) for run in runs]
    return digests[0], paths


def expected(rows, alter=True):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[lang] = (own, *tree([leaf(r) for r in own]))
    root, tops = tree([made[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, paths = made[lang]
        for r, path in zip(own, paths):
            found = r
            if alter and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                found = (*r[:4], r[4].translate(LOWER))
            folded, whole = leaf(found), path + top
            for before, after in whole:
                folded = h(before, folded, after)
            out.append((r[0], leaf(r), subroot, root, h(*(s for level in whole for s in level)), folded, folded == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def manifest(df):
    return merkle_manifest.manifest(df, merkle_manifest.lowered_where_sampled())


def test_whole_table_equals_brute_force(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select(*FIELDS).collect()]
    found = got(op13_merkle_manifest(spark, tables))
    assert found == expected(rows)
    assert {r[-1] for r in found} == {True, False}


def edge_rows():
    rows = [(i, "s", "en", 3, f"Text {i}") for i in range(73)]
    rows += [(5, "s", "en", 3, "Text 5"), (5, "s", "en", 3, "Other"), (None, None, None, None, None), (None, "", "", 0, "")]
    rows += [(3, "Q", "de", -1, "Ärger ÄB"), (900, "long", "fr", 10**12, "LoNg é" * 50_000), (901, "s", "fr", None, "\x00:\n-")]
    return rows


def test_edges(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(edge_rows(), schema)
    extra = df.selectExpr("*", "1 AS tie", "'x' AS digest", "2 AS tree", "3 AS position", "4 AS found")
    assert got(manifest(extra)) == expected(edge_rows())
    assert manifest(df.limit(0)).count() == 0
    alone = df.where("doc_id = 900")
    assert got(manifest(alone)) == expected([r for r in edge_rows() if r[0] == 900])
    assert got(manifest(alone))[0][4] == hashlib.sha256(b"").hexdigest()


def test_untouched_rows_verify(spark):
    df = spark.createDataFrame(edge_rows(), "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle_manifest.manifest(df)
    assert got(found) == expected(edge_rows(), alter=False) and found.where("not verified").count() == 0


def test_many_languages_and_blocks_of_one_level(spark, monkeypatch):
    # Blocks of 8 nodes make several rounds of few rows.
    monkeypatch.setattr(merkle_manifest, "DEPTH", 1)
    monkeypatch.setattr(merkle_manifest, "BLOCK_BITS", 3)
    rows = [(i, "s", f"l{i % 11}" if i % 2 else "hot", i, f"Word {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(manifest(df)) == expected(rows)


def test_sweeps_of_one_block():
    digests = [h(str(i)) for i in range(70)]
    rows = merkle_manifest.sweep_forward(4096, digests, 3)
    root, paths = tree(digests)
    assert [len(r) for r in rows] == [70, 9, 2, 1] and rows[-1] == [root]
    assert [[tuple(s) for s in p[:3]] for p in merkle_manifest.sweep_back(rows, 4096, [("a", "b")])] == paths
    assert all(p[3:] == [("a", "b")] for p in merkle_manifest.sweep_back(rows, 4096, [("a", "b")]))
