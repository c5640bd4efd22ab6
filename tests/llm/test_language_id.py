"""Language labels: forward-backward against enumeration, the gradient, held-out accuracy, edge cases."""

import itertools
import zlib

import numpy as np
import pytest

from recordlens.llm import language_id as lid
from recordlens.llm.queries import op9_language_id

SCHEMA = "doc_id long, text string, lang string, score string"


def enumerate_marginals(emission, transition, start):
    n, size = emission.shape
    total, out = 0.0, np.zeros((n, size))
    for path in itertools.product(range(size), repeat=n):
        weight = np.exp(
            start[path[0]]
            + sum(emission[t, y] for t, y in enumerate(path))
            + sum(transition[a, b] for a, b in zip(path, path[1:]))
        )
        total += weight
        for t, y in enumerate(path):
            out[t, y] += weight
    return out / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 1, 4])
    emission = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
    transition, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    got = lid.marginals(emission, counts, transition, start)
    at = 0
    for n in counts:
        if n:
            assert np.allclose(got[at : at + n], enumerate_marginals(emission[at : at + n], transition, start), atol=1e-6)
        at += n


def test_gradient_is_expected_minus_observed():
    rng = np.random.default_rng(2)
    emission, transition, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    gold = rng.integers(0, 3, (2, 4))

    def loss(e, t, s):
        value = 0.0
        for row in range(2):
            scores = [
                s[p[0]] + sum(e[row, k, y] for k, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
                for p in itertools.product(range(3), repeat=4)
            ]
            g = gold[row]
            value += np.log(np.exp(scores).sum())
            value -= s[g[0]] + sum(e[row, k, y] for k, y in enumerate(g)) + sum(t[a, b] for a, b in zip(g, g[1:]))
        return value

    grads = lid._gradient(emission, gold, transition, start)
    for which, (array, grad) in enumerate(zip((emission, transition, start), grads)):
        for at in itertools.islice(np.ndindex(array.shape), 9):
            args = [emission.copy(), transition.copy(), start.copy()]
            args[which][at] += 1e-5
            up = loss(*args)
            args[which][at] -= 2e-5
            assert grad[at] == pytest.approx((up - loss(*args)) / 2e-5, abs=1e-4)


def sample():
    rows = []
    for i in range(60):
        rows.append(("the house and the garden were under that tree " * 3, "en"))
        rows.append(("der hund und die katze sind nicht unter dem baum " * 3, "de"))
    return rows


@pytest.fixture(scope="module")
def model():
    return lid.fit(sample())


def test_code_switched_text(model):
    labels = lid.label_words("The house and the garden, und die Katze sind nicht unter dem Baum!", model)
    assert [lang for _, lang in labels] == ["en"] * 5 + ["de"] * 8
    assert labels[0][0] == "the"


def test_segments_do_not_change_emissions(model, monkeypatch):
    texts = ["the garden und die katze " * 50, None, "", "x" * 500, "12 34", "Straße ÉTÉ"]
    whole, counts = lid.batch_emissions(texts, model.emission)
    assert counts.tolist() == [250, 0, 0, 1, 0, 2]
    monkeypatch.setattr(lid, "SEGMENT", 37)
    again, same = lid.batch_emissions(texts, model.emission)
    assert same.tolist() == counts.tolist() and np.allclose(whole, again, atol=1e-4)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op9_language_id(spark, folder).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_edges(spark, model):
    rows = [
        (1, None, "en", "x"),
        (2, "", None, "x"),
        (3, "12 + 34 = 46", "en", "x"),
        (4, "the house and the garden", None, "x"),
        (4, "the house and the garden", None, "x"),
        (None, "der hund und die katze", "de", "x"),
        (5, "der hund und die katze " * 20_000, "de", "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = lid.predict(df, model).collect()
    found = sorted((str(r.doc_id), r.lang_pred) for r in out)
    assert found == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("5", "de"), ("None", "de")]
    assert all(0 <= r.score <= 1 for r in out) and {r.score for r in out if r.lang_pred == "und"} == {0.0}
    assert lid.predict(df.limit(0), model).count() == 0
    untrained = lid.train_on(df.limit(0))
    assert {r.lang_pred for r in lid.predict(df, untrained).collect()} == {"und"}


def test_too_many_languages_are_an_error(spark):
    rows = [(i, "the house and the garden", f"a{i:04d}", "x") for i in range(400)]
    rows += [(1000 + i, "der hund und die katze", "de", "x") for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError, match="over 256 distinct"):
        lid.train_on(df)
    few = df.where("doc_id >= 1000 or doc_id < 4")
    n = few.where(lid.remainder(lid.F.col("doc_id"), 4) != 2).select("lang").distinct().count()
    assert n > 1 and len(lid.train_on(few, most_languages=n).languages) == n
    with pytest.raises(ValueError, match="most_languages"):
        lid.train_on(few, most_languages=n - 1)
