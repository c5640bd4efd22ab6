"""Every stage of the pipeline against the brute-force version of its operator, on its own input."""

import random
from collections import defaultdict

import corpus_pipeline
from recordlens.llm import best_fit_packing

from . import test_best_fit_packing as packing
from . import test_ngram_join as ngrams
from . import test_secret_scans as secrets
from . import test_suffix_dedup as suffixes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, tables, folder):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], tables).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_stages_equal_brute_force(spark, tables, tmp_path):
    given, clean, single, cut, redacted, packed = staged(spark, tables, str(tmp_path))
    for df in (clean, single, cut, redacted):
        assert df.columns == COLUMNS
        assert df.where("n_chars <> length(text)").count() == 0
    texts = dict(pairs(given))
    assert all(texts[i] == t for i, t in pairs(clean)) and clean.count() >= 0.8 * given.count()

    assert sorted(i for i, _ in pairs(single)) == sorted(r[0] for r in ngrams.brute(pairs(clean)) if r[-1])

    left = {r[0]: r[1] - r[2] for r in suffixes.brute(pairs(single), corpus_pipeline.PASSAGE_BYTES)}
    assert {i: len(t.encode()) for i, t in pairs(cut)} == left

    after = dict(pairs(redacted))
    for doc_id, text in pairs(cut):
        assert doc_id in after
        if not secrets.base(text) and "AKIA" not in text:
            assert after[doc_id] == text or "[SECRET]" in after[doc_id]

    lengths = defaultdict(list)
    for doc_id, text in pairs(redacted):
        lengths[doc_id].append(len(text.split()))
    packing.check(packed.collect(), lengths, best_fit_packing.CAPACITIES)


def test_run_gives_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "piece", "first_word", "n_words", "bin_id", "bin_size", "place"]
    assert out.count() > 0


def test_passages_of_51_words_are_removed(spark, tables):
    """Passages planted in documents that share nothing else go; the words around them and other documents stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(51)) for _ in range(4)]
    rows = []
    for i in range(40):
        own = [" ".join(word() for _ in range(60)) for _ in range(2)]
        planted = f" {passages[i % 4]} " if i < 20 else " | "
        rows.append((i, planted.join(own), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(pairs(corpus_pipeline.remove_repeated_passages(spark, docs, tables)))
    for i, text, *_ in rows:
        if i >= 20:
            assert out[i] == text
        else:
            left, right = text.split(passages[i % 4])
            # An edge may go with the passage where its bytes are the same in both documents by chance.
            assert len(passages[i % 4]) >= corpus_pipeline.PASSAGE_BYTES and passages[i % 4][20:-20] not in out[i]
            assert out[i].startswith(left[:-20]) and out[i].endswith(right[20:])
