"""Search against brute force, ties, block paths and query plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlens.embedders import HashEmbedder
from recordlens.operators.topk import batch_hits
from recordlens.plans.build import build_index
from recordlens.plans.search import clamp_k, lookup, present, search, search_batch, search_front
from recordlens.sources.store import load_index, publish_index

EMBEDDER = HashEmbedder(16)
WORDS = "disk error network timeout login crash screen slow printer paper update Übung".split()


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        body = " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))
        rows.append((str(i), rng.choice(WORDS) + f" {i}", body, None, None))
    # A third of all records are copies of one text.
    rows += [(f"c{i}", "copy", "disk error disk", "0", "http://x") for i in range(150)]
    df = spark.createDataFrame(rows, "WorkItemId string, Title string, SemanticText string, link string, BugUrl string")
    return build_index(df, EMBEDDER).cache()


QUERIES = ["disk", "Disk Error", "42", "übung", "", "e", "network timeout", "disk"]


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(str(i), q) for i, q in enumerate(QUERIES)]
    return EMBEDDER.embed(spark.createDataFrame(rows, "query_id string, query string"), "query")


def brute_force(index, asked, k):
    rows = index.collect()
    out = []
    for q in asked.collect():
        text, scored = q["query"].strip(), []
        for r in rows:
            semantic = 0.0
            for a, b in zip(q.embedding, r.embedding):
                semantic += a * b
            kw = 0.0
            if text:
                kw += 1.0 if text == r.work_item_id else 0.0
                kw += 0.5 if text.lower() in r.title.lower() else 0.0
                kw += 0.3 if text.lower() in r.semantic_text.lower() else 0.0
            number = int(r.work_item_id) if r.work_item_id.isdigit() else 1 << 62
            final = 0.75 * semantic + 0.25 * kw
            scored.append((-final, number, r.work_item_id, semantic, kw))
        for rank, (f, _, wid, s, kw) in enumerate(sorted(scored)[:k], 1):
            out.append((q.query_id, rank, wid, s, kw, -f))
    return sorted(out)


def as_rows(hits):
    names = ("query_id", "rank", "work_item_id", "semantic_score", "keyword_score", "final_score")
    return sorted(tuple(r[n] for n in names) for r in hits.collect())


@pytest.mark.parametrize("k", [1, 5, 40, 1000])
def test_batch_equals_brute_force(index, asked, k):
    assert as_rows(batch_hits(index, asked, k)) == brute_force(index, asked, k)


def test_query_blocks_give_the_same_result(index, asked):
    blocked = batch_hits(index, asked, 7, block_queries=3, block_rows=60)
    assert as_rows(blocked) == brute_force(index, asked, 7)


def test_block_bytes_also_lead_to_blocks(index, asked):
    assert as_rows(batch_hits(index, asked, 3, block_bytes=600)) == brute_force(index, asked, 3)


def test_blocks_keep_to_their_bounds(spark, tmp_path):
    from recordlens.operators.topk import _query_blocks

    rows = [(f"q{i}", "x" * (i % 50), "y", [0.0, 1.0]) for i in range(200)]
    queries = spark.createDataFrame(rows, "query_id string, query string, lowered string, vector array<double>")
    for number, (most, size) in enumerate(((7, 10_000), (500, 700))):
        parts = max(200 // most, 13_000 // size)
        blocks = [b.collect() for b in _query_blocks(queries, parts, most, size, str(tmp_path / str(number)))]
        assert sorted(r.query_id for b in blocks for r in b) == sorted(r[0] for r in rows)
        assert all(0 < len(b) <= most for b in blocks)


def test_blocks_never_shuffle_the_index(index, asked, monkeypatch):
    from recordlens.operators import topk

    plans, real = [], topk.top_per_query

    def seen(hits, k):
        plans.append(hits._jdf.queryExecution().optimizedPlan().toString())
        return real(hits, k)

    monkeypatch.setattr(topk, "top_per_query", seen)
    batch_hits(index, asked, 2, block_queries=4)
    assert len(plans) > 1 and all("MapInArrow" in p and "Repartition" not in p and "CoGroup" not in p for p in plans)


def test_single_search_equals_batch(index, asked):
    for i, q in enumerate(QUERIES):
        one = search(index, q, 9, embedder=EMBEDDER).collect()
        many = [r for r in brute_force(index, asked, 9) if r[0] == str(i)]
        many.sort(key=lambda r: r[1])
        assert [(r.semantic_score, r.keyword_score, r.final_score) for r in one] == [
            m[3:] for m in many
        ]


def test_top_k_is_a_prefix_of_top_k_plus_one(index):
    shorter = search(index, "disk error", 4, embedder=EMBEDDER).collect()
    assert shorter == search(index, "disk error", 5, embedder=EMBEDDER).collect()[:4]


def test_k_bounds(index, asked):
    for call in (
        lambda: search(index, "x", 0, embedder=EMBEDDER),
        lambda: batch_hits(index, asked, 0),
    ):
        with pytest.raises(ValueError):
            call()
    assert search(index, "x", 10_000, embedder=EMBEDDER).count() == index.count()
    assert [clamp_k(k) for k in ("x", None, 0, 7, "3", 99)] == [5, 5, 1, 7, 3, 20]


def test_all_boosts_add_up(spark):
    df = spark.createDataFrame([("7", "a 7", "b 7")], "WorkItemId string, Title string, SemanticText string")
    got = search(build_index(df, EMBEDDER), " 7 ", 1, embedder=EMBEDDER).first()
    assert got.keyword_score == 1.8
    assert -0.75 <= got.final_score <= 1.2


def test_links_and_ids_of_results(index):
    row = search(index, "disk error disk", 1, embedder=EMBEDDER).first()
    assert (row.work_item_id, row.link) == (0, "http://x")
    found = search_batch(
        index, index.sparkSession.createDataFrame([("q", "disk error disk")], "query_id string, query string"),
        1, embedder=EMBEDDER,
    ).first()
    assert (found.title, found.link) == ("copy", "http://x")


def test_lookup_and_front(index):
    assert [r.final_score for r in lookup(index, " 42 ").collect()] == [1.0]
    assert lookup(index, "4242").count() == 0 and lookup(index, "c1").count() == 0
    exact = search_front(index, "42", embedder=EMBEDDER).collect()
    assert [(r.rank, r.match, r.work_item_id) for r in exact] == [(1, "100.0%", 42)]
    assert search_front(index, "4242", 3, embedder=EMBEDDER).count() == 3
    with pytest.raises(ValueError):
        search_front(index, "  ", embedder=EMBEDDER)


def test_ranks_follow_the_search_order(spark):
    rows = [(i, "same", "text") for i in ("b", "10", "9", "a", "0")]
    df = spark.createDataFrame(rows, "WorkItemId string, Title string, SemanticText string")
    shown = search_front(build_index(df, EMBEDDER), "text", 5, embedder=EMBEDDER)
    assert [r.work_item_id for r in shown.orderBy("rank").collect()] == [0, 9, 10, 0, 0]


def test_present_per_query(index, asked):
    hits = batch_hits(index, asked, 3)
    shown = present(hits, "query_id").where("rank = 1").collect()
    assert len(shown) == len(QUERIES)
    assert {r.match for r in shown if r.final_score > 0} == {"100.0%"}


def test_present_clamps(spark):
    rows = [(1, "a", 1.2), (2, "b", 0.5), (3, "c", -0.1)]
    df = spark.createDataFrame(rows, "work_item_id long, title string, final_score double")
    assert [(r.rank, r.match) for r in present(df).orderBy("rank").collect()] == [
        (1, "100.0%"), (2, "50.0%"), (3, "0.0%"),
    ]
    zero = df.withColumn("final_score", F.lit(-1.0))
    assert {r.match for r in present(zero).collect()} == {"0.0%"}


def test_vectors_of_unequal_length_are_refused(spark, index):
    wrong = spark.createDataFrame([("q", "x", [1.0, 2.0])], "query_id string, query string, embedding array<float>")
    with pytest.raises(Exception, match="vector length"):
        batch_hits(index, wrong, 1).collect()
    with pytest.raises(Exception, match="differ in length"):
        search(index, "x", 1, vector=F.array(F.lit(1.0), F.lit(2.0))).collect()


def test_hash_embedder(spark):
    texts = ["", None, "disk disk error", "Disk, DISK error!", "--"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.embedding for r in EMBEDDER.embed(df, "t").orderBy("i").collect()]
    assert got[0] == got[1] == got[4] == [0.0] * 16
    assert got[2] == got[3]
    assert np.linalg.norm(got[2]) == pytest.approx(1.0, abs=1e-6)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, index, asked, tmp_path):
    base = str(tmp_path / "index")
    publish_index(index, base)
    stored = load_index(spark, base)
    plan = plan_of(search(stored, "disk", 5, embedder=EMBEDDER))
    assert "TakeOrderedAndProject" in plan
    assert "fingerprint" not in plan.split("ReadSchema")[1]
    assert "EqualTo(work_item_id,42)" in plan_of(lookup(stored, "42"))
    hits = plan_of(batch_hits(stored, asked, 5))
    assert hits.count("WindowGroupLimit") == 4 and "Cartesian" not in hits
    assert "NestedLoop" not in hits


def test_batch_search_over_repeated_ids(spark, index, asked):
    doubled = index.unionByName(index)
    rows = search_batch(doubled, asked, 2).groupBy("query_id").count().collect()
    assert rows and all(r["count"] == 2 for r in rows)
    with pytest.raises(ValueError, match="unique"):
        search_batch(index, asked.unionByName(asked), 2)
