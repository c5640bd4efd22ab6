"""Edge values of the column functions."""

import hashlib
import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordlens.embedders import _hash_vectors
from recordlens.functions import display, links, text, vectors
from recordlens.operators.ordering import display_sort


def column(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    rows = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_whitespace_is_what_python_strips():
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip(spark):
    raw = ["　 a b\x1c\n", "", " \xa0 ", None, "x", " é "]
    assert column(spark, raw, text.strip) == [r if r is None else r.strip() for r in raw]
    assert column(spark, raw, text.is_blank) == [not (r or "").strip() for r in raw]


def test_normalize_id(spark):
    cases = {
        "12.0": "12", "12.0.0": "12.0", "1.05.0": "1.05", "-3.0": "-3.0", " 7 ": "7",
        ".0": ".0", "0.0": "0", "007": "007", "1.0e3": "1.0e3", "": "", "a.0": "a.0",
    }
    assert column(spark, list(cases), text.normalize_id) == list(cases.values())


def test_random_texts_against_python(spark):
    rng = random.Random(11)
    alphabet = list("0123.0.0aNnoneulL \t\n\x1c\xa0é|-e") + [".0", "nan", " ", "none"]
    raw = ["".join(rng.choices(alphabet, k=rng.randint(0, 7))) for _ in range(3000)]

    def cleaned(s):
        return "" if s.strip().lower() in text.MISSING_TEXTS else s.strip()

    digits = set("0123456789")

    def identifier(s):
        """Split at the last point: a zero behind it goes when digits and whole '.0' groups stand before."""
        head, point, tail = s.strip().rpartition(".")
        groups = head.split(".0")
        numeric = any(groups) and all(set(g) <= digits for g in groups)
        return head if point and tail == "0" and numeric else s.strip()

    assert column(spark, raw, text.strip) == [s.strip() for s in raw]
    assert column(spark, raw, text.normalize_id) == [identifier(s) for s in raw]
    assert column(spark, raw, text.clean_text) == [cleaned(s) for s in raw]


def test_id_to_int_table(spark):
    cases = {
        "12": 12, " 7 ": 7, "007": 7, "12.9": 12, "-3.7": -3, "-0.5": 0, "1e3": 1000, "2.5e2": 250, ".5": 0,
        "5.": 5, "": 0, " ": 0, "abc": 0, "1x": 0, "--1": 0, "nan": 0, "inf": 0, "1e400": 0, "9223372036854775807": 2**63 - 1,
    }
    assert column(spark, list(cases), text.id_to_int) == list(cases.values())


def test_missing_text(spark):
    raw = [None, " ", "NaN", " None ", "NULL", "nano", "none.", "a"]
    assert column(spark, raw, text.clean_text) == ["", "", "", "", "", "nano", "none.", "a"]


def test_embedding_text(spark):
    rows = [("T", None, "S"), (" ", "nan", None), ("T", "x", "none"), (" a ", "b", " c ")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.select(text.embedding_text(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["T S", "", "T x", "a b c"]


def test_fingerprint(spark):
    df = spark.createDataFrame([("1", "ä", "body"), ("2", None, "x")], "a string, b string, c string")
    got = df.select(text.fingerprint(F.col("a"), F.col("b"), F.col("c"))).collect()
    want = [hashlib.sha256(p.encode()).hexdigest() for p in ("1|ä|body", "2||x")]
    assert [r[0] for r in got] == want


def test_id_to_int(spark):
    cases = {
        "12": 12, "12.9": 12, "-3.7": -3, "abc": 0, "nan": 0, "inf": 0, "1e3": 1000,
        " 5 ": 5, "1d": 0, "": 0, "99999999999999999999": 0, "-8": -8,
    }
    assert column(spark, list(cases), text.id_to_int) == list(cases.values())
    assert column(spark, [None], text.id_to_int) == [0]


def test_links(spark):
    raw = ["0", "0.0", " 0.0.0.0 ", "nan", "None", "NAN", None, " http://a "]
    want = ["", "", "", "", "", "NAN", "", "http://a"]
    assert column(spark, raw, links.clean_link) == want
    rows = [("u", "l"), (" ", "l"), (None, "0"), (None, None), ("nan", "l")]
    df = spark.createDataFrame(rows, "u string, l string")
    got = df.select(links.choose_link(F.col("u"), F.col("l"))).collect()
    assert [r[0] for r in got] == ["u", "l", "", "", ""]


def test_cell_references(spark):
    assert column(spark, ["A1", "$C$7", "AA10", "zz3", "A", "1", "ABCD1"], links.reference_column) == [
        1, 3, 27, 702, None, None, None,
    ]


def test_hyperlink_argument(spark):
    cases = {
        'HYPERLINK("http://a,b",1)': '"http://a,b"',
        '=hyperlink( "x"&A2 , "y")': '"x"&A2',
        'HYPERLINK(IF(B1>0,"(,",CONCAT(A1,"b")),"t")': 'IF(B1>0,"(,",CONCAT(A1,"b"))',
        'HYPERLINK("x")': '"x"',
        'HYPERLINK(' + 'F(' * 12 + 'A1,"),("' + ')' * 12 + ',"t")': 'F(' * 12 + 'A1,"),("' + ')' * 12,
        "SUM(A1)": "",
    }
    assert column(spark, list(cases), links.hyperlink_argument) == list(cases.values())


def test_concat_tokens(spark):
    raw = ['"a&b"&$A$2& "c"', 'IF(A1,"x","y")&"z"', '"a""b"']
    assert column(spark, raw, links.concat_tokens) == [
        ['"a&b"', "$A$2", '"c"'], ['IF(A1,"x","y")', '"z"'], ['"a""b"'],
    ]


def test_edit_url_gets_the_id(spark):
    cases = {
        "https://h/edit": "https://h/edit/9", "https://h/edit/": "https://h/edit/9",
        "https://h/edit/9": "https://h/edit/9", "ftp://h/edit": "ftp://h/edit", "": "",
    }
    fn = lambda c: links.complete_edit_url(c, F.lit("9"))
    assert column(spark, list(cases), fn) == list(cases.values())


def test_shift_rows(spark):
    df = spark.createDataFrame([('HYPERLINK("a2"&$B2&C22&D2)', 2, 17)], "t string, b int, r int")
    got = df.select(links.shift_rows(F.col("t"), F.col("b"), F.col("r"))).first()[0]
    assert got == 'HYPERLINK("a17"&$B17&C22&D17)'


def test_normalize_vector(spark):
    got = column(spark, [[3.0, 4.0], [0.0, 0.0]], vectors.l2_normalize, "array<float>")
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
    with pytest.raises(PySparkException):
        column(spark, [[1.0, None]], vectors.l2_normalize, "array<float>")


def test_unit_norm(spark):
    raw = [[1.0, 0.0], [0.9995, 0.0], [0.998, 0.0], [math.nan, 1.0], [math.inf, 0.0], None]
    assert column(spark, raw, vectors.has_unit_norm, "array<float>") == [
        True, True, False, False, False, False,
    ]


def test_percent_of_best(spark):
    rows = [(i / 1600, 1.0) for i in range(1601)] + [(i / 997, 0.7) for i in range(698)]
    df = spark.createDataFrame(rows, "s double, b double")
    got = df.select("s", "b", display.percent_of_best(F.col("s"), F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == [f"{min(100.0, r.s / r.b * 100.0):.1f}%" for r in got]
    nothing = spark.createDataFrame([(0.5, 0.0)], "s double, b double")
    assert nothing.select(display.percent_of_best(F.col("s"), F.col("b"))).first()[0] == "0.0%"


def test_display_sort(spark):
    values = ["abc", "10", " ", "50%", "9", "Z", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    up = [r.v for r in display_sort(df, "v").collect()]
    down = [r.v for r in display_sort(df, "v", desc=True).collect()]
    assert [v for v in up if v.strip()] == ["9", "10", "50%", "abc", "Z"]
    assert not up[-1].strip() and down == up[::-1]


def test_short_timestamp(spark):
    got = spark.sql("select timestamp'2024-01-05 15:04:00' t").select(
        display.short_timestamp(F.col("t"))
    )
    assert got.first()[0] == "05 Jan 2024 03:04 PM"


def test_hash_vectors_are_the_same_in_blocks():
    rows = pa.array([["a"], ["b", "c", "", "d"] * 5, [], ["e", "a"] * 7, [], []], pa.list_(pa.string()))
    want = _hash_vectors(rows, 8).to_pylist()
    assert all(_hash_vectors(rows, 8, block).to_pylist() == want for block in (1, 2, 3, 7, 36, 100))
    assert _hash_vectors(rows.slice(1, 3), 8, 2).to_pylist() == want[1:4]
    assert want[2] == [0.0] * 8 and _hash_vectors(rows.slice(0, 0), 8).to_pylist() == []


def test_hash_vectors_of_a_large_batch_need_little_memory():
    rows = pa.array([["some", "words", "of", "text"] * 500] * 1000, pa.list_(pa.string()))  # two million tokens
    tracemalloc.start()
    try:
        _hash_vectors(rows, 8)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()
