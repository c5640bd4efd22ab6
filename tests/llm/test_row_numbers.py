"""Row numbers must not depend on how a later scan is split, as when executors come or go between two jobs."""

import pytest

from recordlens.llm import common, ngram_join, secret_scans, suffix_dedup

SPLITS = "spark.sql.files.minPartitionNum"  # stands for the cores alive when a job is planned


@pytest.fixture
def docs(spark, tmp_path, monkeypatch):
    """Eight files, scanned in eight splits until the first table is written, in one afterwards."""
    passage = " ".join(f"shared{i}" for i in range(80))
    rows = []
    for i in range(32):
        own = " ".join(f"w{i}x{k}" for k in range(40))
        rows.append((i, f"{own} {passage}" if i % 8 == 3 else f"{own} token=live{i:010d}" if i % 8 == 5 else own, f"s{i}"))
    rows += [(100 + i, rows[i][1], "copy") for i in (2, 9)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8, "doc_id").write.parquet(path)
    spark.conf.set(SPLITS, "64")
    real = common.materialize

    def changing(df, *args, **kwargs):
        out = real(df, *args, **kwargs)
        spark.conf.set(SPLITS, "1")
        return out

    for module in (common, ngram_join, secret_scans, suffix_dedup):
        monkeypatch.setattr(module, "materialize", changing)
    yield spark.read.parquet(path), rows
    spark.conf.unset(SPLITS)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_suffix_dedup(docs):
    df, rows = docs
    passages = {i for i, text, _ in rows if "shared" in text}
    copies = {2, 9, 102, 109}
    out = texts(suffix_dedup.remove_repeats(df, 300))
    for i, text, _ in rows:
        assert ("shared40" in out[i]) is False
        if i not in passages | copies:
            assert out[i] == text
    assert all(f"w{i}x0" in out[i] for i in passages)


def test_ngram_join(docs):
    df, rows = docs
    assert texts(ngram_join.drop_duplicates(df)) == {i: text for i, text, _ in rows if i < 100}


def test_secret_scans(docs):
    df, rows = docs
    out = texts(secret_scans.redact(df))
    assert out == {i: f"{text.split(' token=')[0]} [SECRET]" if " token=" in text else text for i, text, _ in rows}
