"""Packing: every word is in one place, bins hold what they may, and the plan equals a bin-by-bin best fit."""

import random
from collections import Counter, defaultdict

from recordlens.llm import best_fit_packing as packing
from recordlens.llm.queries import op6_best_fit_packing

SCHEMA = "doc_id long, text string, piece string, bin_id int"


def check(rows, lengths, capacities):
    """lengths: doc_id -> list of word counts of its rows."""
    bins = defaultdict(list)
    words = defaultdict(list)
    for r in rows:
        bins[r.bin_id, r.bin_size].append((r.place, r.n_words))
        words[r.doc_id].append((r.piece, r.first_word, r.n_words))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), parts in bins.items():
        end = 0
        for place, n in sorted(parts):
            assert place == end and n > 0
            end += n
        assert end <= size and size == min(c for c in capacities if c >= end)
    longest = max(capacities)
    for doc_id, counts in lengths.items():
        want = Counter(
            (k, k * longest, min(longest, n - k * longest)) for n in counts for k in range((n + longest - 1) // longest)
        )
        assert Counter(words.get(doc_id, [])) == want
    return bins


def one_by_one(lengths, capacities, overhead):
    """Best-fit decreasing, one piece and one bin at a time; returns the contents of the bins."""
    left = Counter(lengths)
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fitting:
            best = min(fitting, key=lambda b: b[0] - sum(b[1]))
        else:
            cost = lambda c: ((c + overhead) / (min(c // n, left[n]) * n), c)  # noqa: B023, E731
            best = (min((c for c in capacities if c >= n), key=cost), [])
            bins.append(best)
        best[1].append(n)
        left[n] -= 1
    return sorted(tuple(sorted(b)) for _, b in bins)


def test_plan_fills_bins_as_well_as_one_by_one():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [min(64, int(rng.expovariate(0.08)) + 1) for _ in range(rng.randrange(1, 300))]
        placed, bins = packing.plan_bins(Counter(lengths), (8, 16, 32, 64), 2)
        contents = defaultdict(list)
        for length, low, high, each, first, _ in placed:
            for k in range(high - low):
                contents[first + k // each].append(length)
        assert Counter(x for b in contents.values() for x in b) == Counter(lengths)
        held = {b: used for low, high, _, used in bins for b in range(low, high)}
        assert {b: sum(c) for b, c in contents.items()} == held
        size = {b: s for low, high, s, _ in bins for b in range(low, high)}
        by_plan = sum(size.values())
        by_one = sum(next(c for c in (8, 16, 32, 64) if c >= sum(b)) for b in one_by_one(lengths, (8, 16, 32, 64), 2))
        assert by_plan <= 1.1 * by_one + 64


def test_whole_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    lengths = {d.doc_id: [len(d.text.split())] for d in docs}
    rows = op6_best_fit_packing(spark, tables).collect()
    bins = check(rows, lengths, packing.CAPACITIES)
    assert sum(n for counts in lengths.values() for n in counts) >= 0.9 * sum(size for _, size in bins)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (4, "a b c"), (None, "x y"), (5, "w " * 1000), (6, "v " * 64), (7, "u")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    lengths = defaultdict(list)
    for doc_id, text in docs:
        lengths[doc_id].append(len((text or "").split()))
    check(packing.pack(df, (8, 16, 32, 64), 2).collect(), lengths, (8, 16, 32, 64))
    assert packing.pack(df.limit(0)).count() == 0


def test_hot_length(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "repeat('w ', 100) as text", "'x' as piece", "1 as bin_id")
    bins = check(packing.pack(df).collect(), {i: [100] for i in range(5000)}, packing.CAPACITIES)
    assert sum(size for _, size in bins) <= 1.1 * 500_000
