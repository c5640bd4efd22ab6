"""Columns of any name come back unchanged from the operators that return whole documents."""

import pytest

from recordlens.llm import ngram_join, secret_scans, suffix_dedup

NAMES = ["__uid", "__cut", "__ranges", "__live", "row", "cut", "ranges", "live", "left", "key", "a.b", "component", "spans"]


@pytest.fixture
def docs(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [f"own{i} words {passage} end{i} token=live{i:010d}" for i in range(3)] + [None, "", passage + " alone"]
    rows = [(i, t, "s", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema), {r[0]: r for r in rows}


@pytest.mark.parametrize("apply", [suffix_dedup.remove_repeats, ngram_join.drop_duplicates, secret_scans.redact])
def test_columns_come_back(docs, apply):
    df, rows = docs
    out = apply(df)
    assert out.columns == df.columns
    found = [tuple(r) for r in out.collect()]
    assert len(found) >= 3 and all(r[2:] == rows[r[0]][2:] for r in found)
