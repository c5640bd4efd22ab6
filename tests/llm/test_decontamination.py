"""Decontamination against plain Python."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from recordlens.llm import decontamination
from recordlens.llm.queries import op11_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NAMES = "doc_id n_words n_hit n_items items_sha256 contaminated".split()
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, window=10):
    wanted = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            wanted.setdefault(tuple(words[at : at + n]), set()).add(item)
    sizes = {len(w) for w in wanted}
    out = []
    for doc_id, text in docs:
        words, hit, met = words_of(text), set(), set()
        for n in sizes:
            for at in range(len(words) - n + 1):
                found = wanted.get(tuple(words[at : at + n]))
                if found:
                    hit.update(range(at, at + n))
                    met |= found
        ids = sorted(str(i) for i in met if i is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_whole_table_equals_brute_force(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(op11_decontamination(spark, tables)) == expected(docs, items)


PASSAGE = "One two, three FOUR five-six seven eight nine ten eleven twelve."


def edge_items():
    return [
        (1, PASSAGE), (1, PASSAGE), (2, "alpha BETA gamma"), (3, None), (4, " \n.,"), (5, "solo"), (6, "ab cd"),
        (7, "same same same same same same same same same same same same"), (None, "nameless words in here"), (10, PASSAGE),
    ]


def edge_docs():
    text = PASSAGE.lower()
    return [
        (1, None), (2, ""), (3, PASSAGE), (3, PASSAGE), (4, "x " + text + " y"), (5, "one two three four five six seven eight nine"),
        (6, "one two three four five six seven eight nine ten"), (None, "alpha"), (8, "beta gamma"), (9, "alpha\x00beta_gamma"),
        (10, "é" + "solo"), (11, "a solo\n\nab  cd"), (12, "same " * 40), (13, "nameless words in here"), (14, "ten eleven twelve"),
        (15, "w" * (decontamination.BLOCK + 5) + " solo " + "Ж" * decontamination.BLOCK),
        (16, "three four five six seven eight nine ten eleven twelve thirteen"),
        (17, " ".join(f"f{i}" for i in range(50_000)) + " " + text),
    ]


def test_edges(spark):
    docs, items = edge_docs(), edge_items()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontamination.report(df, bench)) == expected(docs, items)
    assert decontamination.report(df.limit(0), bench).count() == 0
    assert all(r[2:4] == (0, 0) and not r[5] for r in got(decontamination.report(df, bench.limit(0))))


def test_random_texts_of_few_words(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("a b c d".split()) for _ in range(n))
    docs = [(i, some(rng.randrange(60))) for i in range(200)]
    items = [(i, some(rng.choice([1, 2, 3, 5, 9, 10, 11, 14]) + 3 * (i % 3))) for i in range(20)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert got(decontamination.report(df, bench)) == expected(docs, items)


def test_hot_passage_is_joined_in_pieces(spark, monkeypatch):
    from recordlens.operators import joins

    docs = [(i, f"start{i} {PASSAGE} end{i}" if i % 3 else f"clean words number {i}") for i in range(600)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(edge_items(), "item_id long, text string")
    real = joins.spread_join
    monkeypatch.setattr(decontamination, "spread_join", lambda *a, **k: real(*a, **k, limit=-1))
    assert got(decontamination.report(df, bench)) == expected(docs, edge_items())


def test_clean_keeps_columns_of_any_name(spark):
    names = "doc_id long, text string, uid int, row string, candidates int, `a.b` int, n_words string"
    docs = [(1, PASSAGE, 1, "r", 2, 3, "n"), (2, "clean", 4, "s", 5, 6, "m"), (3, None, 7, None, 8, 9, None)]
    bench = spark.createDataFrame(edge_items(), "item_id long, text string")
    out = decontamination.clean(spark.createDataFrame(docs, names), bench)
    assert out.columns == "doc_id text uid row candidates a.b n_words".split()
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(docs[1:], key=repr)


def test_spans_are_maximal(spark):
    df = spark.createDataFrame([(1, f"{PASSAGE} gap {PASSAGE} solo ab cd")], "doc_id long, text string")
    bench = spark.createDataFrame(edge_items(), "item_id long, text string")
    row = decontamination.find(df, bench).first()
    assert [tuple(s) for s in row.spans] == [(0, 12), (13, 28)] and row["items"] == ["1", "10", "5", "6"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_a_column(kind):
    texts = ["One, two", None, "three", "", "four", "x" * (decontamination.BLOCK + 1), "Ünd Ünd"]
    found = decontamination.Texts(pa.array(["skipped", *texts], kind).slice(1))
    listed = [found.words(i, i + 1).decode() for i in range(len(found.start))]
    assert listed == [w for t in texts for w in words_of(t)]
    assert found.first.tolist() == [0, 2, 2, 3, 3, 4, 5, 7]
    hashes = found.hashes()
    assert hashes[-1] == hashes[-2] and len(set(hashes.tolist())) == 6


@pytest.mark.parametrize("block", [1, 7, 40, 300])
def test_small_blocks_and_long_texts_in_parts(spark, block):
    rng = random.Random(block)
    some = lambda n: " ,\n"[n % 3].join(rng.choice("a b c dd eeeeeeeee".split()) for _ in range(n))
    docs = [(i, some(rng.randrange(90)) + " ." * (i % 40)) for i in range(60)] + edge_docs()[:14]
    items = [(i, some(rng.choice([1, 2, 5, 9, 10, 11, 40]))) for i in range(20)] + [(99, "\u00e9" * 500 + " a b"), (100, "x" * 500)]
    docs += [(200 + i, f"a b {text} {some(4)}") for i, text in items] + [(300, "\u00e9" * 500 + " a  b"), (301, "." * 500)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert got(decontamination.report(df, bench, block=block)) == expected(docs, items)


@pytest.mark.parametrize("texts", [["a b " * 250] * 8000, ["a b " * 2_000_000]])
def test_arrays_do_not_grow_with_the_batch(texts):
    import tracemalloc

    held = bytes(1 << 17)
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "text": texts})
    for work in (decontamination._count_shingles(held, [1, 2, 3], 1 << 20), decontamination._find_shingles(held, [1, 2, 3], 10, 1 << 20)):
        tracemalloc.start()
        rows = [b.num_rows for b in work(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(rows) in (0, len(texts)) and peak < 80 << 20, (peak, len(rows))
