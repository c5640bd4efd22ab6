"""Suffix-array dedup against a dictionary of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from recordlens.llm import suffix_dedup
from recordlens.llm.queries import op4_suffix_dedup

SCHEMA = "doc_id long, text string, key string, n_chars int"


def brute(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    count = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for (doc_id, _), raw in zip(docs, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_whole_table_equals_brute_force(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs, 400)
    assert got(op4_suffix_dedup(spark, tables)) == want
    assert sum(r[2] for r in want) > 10_000


def corpus(rng, n=150):
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    shared = ["".join(rng.choice("xyz") for _ in range(rng.randrange(30, 120))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = ["".join(rng.choice("pqrstuvw ü") for _ in range(rng.randrange(0, 60))) for _ in range(4)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        if i % 3:
            parts.insert(rng.randrange(4), passage[rng.randrange(20) : rng.randrange(60, 90)])
        docs.append((i, "".join(parts)))
    docs += [(n + i, docs[i][1]) for i in range(10)]
    docs += [(900, "ab" * 200), (901, "z" * 150), (902, "z" * 300 + "q"), (903, "abc" * 5), (904, None), (905, ""), (None, "k" * 40)]
    return docs


@pytest.mark.parametrize("most_pieces", [1000, 5])
def test_random_corpus(spark, monkeypatch, most_pieces):
    monkeypatch.setattr(suffix_dedup, "SORTED_AT_ONCE", 3000)
    monkeypatch.setattr(suffix_dedup.repeated_ranges, "__defaults__", (400, most_pieces))
    docs = corpus(random.Random(3))
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    want = brute(docs, 40)
    assert got(suffix_dedup.report(df, 40)) == want
    assert 0 < sum(r[2] for r in want)
    out = suffix_dedup.remove_repeats(df, 40)
    assert out.columns == df.columns and out.count() == len(docs)
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[900].text == "" and texts[900].n_chars == 0 and texts[903].text == "abc" * 5 and texts[904].text is None
    assert suffix_dedup.report(df.limit(0), 40).count() == 0


def test_chunks_of_long_texts(spark, monkeypatch):
    rng = random.Random(8)
    block = "".join(rng.choice("abcdefgh") for _ in range(3000))
    docs = [(1, block + "tail" + block[:700]), (2, "head" + block[500:1500]), (3, "".join(rng.choice("ijkl") for _ in range(5000)))]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    assert got(suffix_dedup.report(df, 40)) == brute(docs, 40)


def test_two_stage_sort_equals_plain_sort():
    rng = np.random.default_rng(2)
    for letters in (2, 3, 30):
        for n in (1, 2, 50, 600):
            text = rng.integers(97, 97 + letters, n).astype(np.uint8)
            raw = text.tobytes()
            order = suffix_dedup.suffix_array(text, np.ones(n, bool), n + 1)
            assert order.tolist() == sorted(range(n), key=lambda p: raw[p:])


def test_needed_suffixes_alone_keep_their_order():
    rng = np.random.default_rng(4)
    for _ in range(30):
        text = rng.integers(97, 100, 300).astype(np.uint8)
        raw = text.tobytes()
        real = np.zeros(300, bool)
        real[40:90] = real[150:151] = real[280:] = True
        order = suffix_dedup.suffix_array(text, suffix_dedup._closed(text, real), 301)
        assert order[real[order]].tolist() == sorted(np.flatnonzero(real).tolist(), key=lambda p: raw[p:])


def test_common_prefixes():
    rng = np.random.default_rng(6)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    raw = text.tobytes()
    order = np.array(sorted(range(360), key=lambda p: raw[p : p + 40]))
    got_common = suffix_dedup.common_prefixes(text, order, 40)
    for a, b, n in zip(order, order[1:], got_common):
        x, y = raw[a : a + 40], raw[b : b + 40]
        assert n == next((i for i in range(40) if x[i] != y[i]), 40)
