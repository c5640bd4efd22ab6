"""Toxicity classifier: held-out accuracy, hashing against a plain loop, and edge cases."""

import zlib

import numpy as np

from recordlens.llm import toxicity
from recordlens.llm.queries import op7_toxicity

SCHEMA = "doc_id long, text string, score string, label int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    rows = op7_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.96
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.7
    assert np.mean([1 - r.predicted for r in rows if not r.toxic]) > 0.985


def test_segments_do_not_change_the_buckets(monkeypatch):
    texts = ["Alpha beta, gamma! " * 40, None, "", "x", "Ünïcode 😀 text"]

    def sets():
        found = [set() for _ in texts]
        for rows, buckets in toxicity.bucket_blocks(iter(texts)):
            for r, b in zip(rows.tolist(), buckets.tolist()):
                found[r].add(b)
        return found

    whole = sets()
    monkeypatch.setattr(toxicity, "SEGMENT", 13)
    assert sets() == whole
    assert not whole[1] and not whole[2] and whole[3]


def labelled(spark):
    rows = [(i, ("you idiot thing " if i % 3 == 0 else "a fine thing ") + str(i), "x", int(i % 3 == 0)) for i in range(120)]
    return spark.createDataFrame(rows, SCHEMA)


def test_edges(spark):
    data = labelled(spark)
    model = toxicity.train(data.selectExpr("doc_id as key", "text", "label"), per_class=30)
    docs = spark.createDataFrame(
        [(1, None, "a", 0), (2, "", "b", 0), (2, "", "b", 0), (None, "what an IDIOT!", "c", 1), (3, "fine " * 400_000, "d", 0)],
        SCHEMA,
    )
    out = toxicity.predict(docs, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].score == by_id[2].score and by_id[None].predicted == 1 and by_id[3].predicted == 0
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.predict(docs.limit(0), model).count() == 0


def test_one_class_and_no_labels(spark):
    data = labelled(spark).selectExpr("doc_id as key", "text", "label")
    docs = labelled(spark)
    for rows, want in ((data.where("label = 1"), 1.0), (data.where("label = 0"), 0.0), (data.limit(0), 0.0)):
        model = toxicity.train(rows)
        assert {round(r.score, 9) for r in toxicity.predict(docs, model).collect()} == {want}
