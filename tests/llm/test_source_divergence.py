"""Source divergence against plain Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from recordlens.llm import source_divergence
from recordlens.llm.queries import op12_source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NAMES = "lang source part item value rank".split()
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def expected(docs, least=3, most=200):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(LOWER)))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in d[2])
        kept = [t for t, n in in_docs.items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update({t: terms[t] for t in kept if t in terms})
        total = sum(counts.values(), Counter())

        def share(count):
            n = sum(count.values())
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        shares, q = {s: share(c) for s, c in counts.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for source, p in shares.items():
            pairs = [(sum(f(p[t], r[t]) for t in kept), o) for o, r in shares.items() if o != source]
            terms = [(f(p[t], q[t]), t) for t in kept if counts[source][t] and p[t] > q[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                ordered = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
                ordered = ordered if part == "pair" else ordered[:most]
                out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def test_whole_table_equals_brute_force(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("lang", "source", "text").collect()]
    assert got(op12_source_divergence(spark, tables)) == expected(docs)


def edge_docs():
    rows = [(None, None, None), ("", "", ""), ("en", "a", "the THE the cat"), ("en", "a", "the cat, Éa éa"), ("en", "a", "the cat, Éa éa")]
    rows += [("en", "b", "the dog_dog Éa"), ("en", None, None), ("de", "x", "einmal"), ("de", "y", "zweimal"), (None, "z", "a b c")]
    rows += [("xx", "only", "same same"), ("xx", "only", "same"), ("xx", "only", "same one"), ("en", "c", "z" * 1000 + " the " * 50)]
    return rows


def test_edges(spark):
    docs = edge_docs()
    df = spark.createDataFrame([(i, *d, 1, "v") for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string, n int, term string")
    assert got(source_divergence.audit(df)) == expected(docs)
    assert source_divergence.audit(df.limit(0)).count() == 0


def test_small_slices_segments_and_flushes(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = [
        (rng.choice(["en", "de"]), "hot" if i % 3 else f"s{i % 7}", " ".join(rng.choices(words, range(300, 0, -1), k=rng.randrange(80))))
        for i in range(300)
    ]
    monkeypatch.setattr(source_divergence, "SEGMENT", 16)
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    assert got(source_divergence.audit(df, most_terms=20)) == expected(docs, most=20)


def test_tasks_write_rows_per_bucket_not_per_term(spark):
    docs = [("en" if i % 2 else "de", f"s{i % 5}", " ".join(f"w{chr(97 + (i + j) % 26) * (j % 40 + 1)}" for j in range(200))) for i in range(50)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").coalesce(1)
    rows = source_divergence.packed_counts(df, buckets=8).collect()
    assert 0 < len(rows) <= 2 * 8
    assert sum(len(r.lengths) // 4 for r in rows) > 10 * len(rows)


def test_blocks_and_long_texts_count_alike(monkeypatch):
    rng = random.Random(3)
    words = ["The", "\u00c9a", "x", "don't", "\u00df9\u00e9", "", "--", "caf\u00e9", "yy" * 9, "\U0001f600z"]
    docs = [(rng.choice(["en", ""]), f"s{i % 6}", rng.choice([" ", ",", ""]).join(rng.choices(words, k=rng.randrange(30)))) for i in range(200)]
    for name, value in (("SLICE", 40), ("HELD_BYTES", 300)):
        monkeypatch.setattr(source_divergence, name, value)
    table = pa.table({"lang": [d[0] for d in docs], "source": [d[1] for d in docs], "text": [d[2] for d in docs]})
    rows = pa.Table.from_batches(source_divergence._count_terms(3)(table.to_batches(max_chunksize=16))).sort_by("bucket")
    found = pa.Table.from_batches(source_divergence._add_up(3)(rows.to_batches(max_chunksize=5)))
    want = []
    for lang in ("en", ""):
        terms = [(source, Counter(TERM.findall(text.translate(LOWER)))) for one, source, text in docs if one == lang]
        for term in set().union(*(c for _, c in terms)):
            counts = sum((Counter({s: c[term]}) for s, c in terms), Counter())
            if sum(term in c for _, c in terms) >= 3:
                want.append((lang, term, counts.total(), sorted(counts.items())))
        per_source = Counter(s for s, _ in terms)
        want.append((lang, "", len(terms), sorted(per_source.items())))
    rows = [(r["lang"], r["term"], r["total"], [(x["source"], x["n"]) for x in r["by_source"]]) for r in found.to_pylist()]
    assert sorted(rows) == sorted(want)


def test_terms_in_slices(monkeypatch):
    monkeypatch.setattr(source_divergence, "SLICE", 7)
    text = "One two,three FOUR éé 5six sevenseven eight"
    parts = list(source_divergence.terms_of(text.encode()))
    assert [t.decode() for p in parts for t in p] == TERM.findall(text.translate(LOWER)) and len(parts) > 2


def test_counts_beyond_64_bits_of_product(spark):
    rows = spark.createDataFrame([(10**13, 10**15, 7)], "n long, size long, v long")
    found = rows.select(source_divergence.share(rows.n, rows.size, rows.v)).first()[0]
    assert found == 1 + 10**9 * (10**13 + 1) // (10**15 + 7)
    assert source_divergence.shares_of(np.array([10**13]), 10**15, 7).tolist() == [found]


def test_runs_of_columns_meet_as_plain_sums():
    rng = random.Random(9)
    length = np.array([rng.randrange(1, 5) for _ in range(200)])
    a, b = (np.array([rng.choice([0, 0, 0, 1, 2]) for _ in range(200)]) for _ in range(2))
    begins = np.cumsum(length) - length
    runs = []
    for column in (a, b):
        starts, counts = source_divergence.run_lengths(column, begins)
        assert len(starts) == 1 + (column[1:] != column[:-1]).sum()
        runs.append((starts, source_divergence.shares_of(counts, 500, 500)))
    p, q = (source_divergence.shares_of(c, 500, 500).tolist() for c in (a, b))
    want = (
        sum((x - y) ** 2 // y * n for x, y, n in zip(p, q, length.tolist())),
        sum((x - y) ** 2 // x * n for x, y, n in zip(p, q, length.tolist())),
    )
    assert source_divergence.intersected(*runs, int(length.sum())) == want
