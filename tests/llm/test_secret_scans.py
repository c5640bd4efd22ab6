"""Secret scan against Python's regular expressions."""

import hashlib
import re

from pyspark.sql import functions as F

from recordlens.llm import secret_scans
from recordlens.llm.queries import op5_secret_scans

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
SCHEMA = "doc_id long, text string, source string, spans string, hash int"


def base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e, *_ in spans)


def expected(docs):
    out = []
    for i, text, _ in docs:
        spans = base(text)
        counts = [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        out.append((i, *counts, hashlib.sha256(joined(spans).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_whole_table_equals_brute_force(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "source").collect()]
    result = op5_secret_scans(spark, tables).cache()
    assert got(result) == expected(docs)
    assert result.count() == len(docs)


def edge_docs():
    key = "AKIA" + "Q" * 16
    return [
        (1, None, None),
        (2, "", "a"),
        (3, "secret: token: abcdef token=abcdefg", "a"),
        (4, 'é😀 PassWord" = \'hunter2hunter2 ' + key + " " + "0af" * 9, "b"),
        (4, 'é😀 PassWord" = \'hunter2hunter2 ' + key + " " + "0af" * 9, "b"),
        (5, "token=" + "ab12" * 8, None),
        (6, "AKIAAKIA" + "Z" * 11 + " AKIA" + "Z" * 15, "c"),
        (None, "api_key=12345 apikey:123456 API-KEY=1234567", "c"),
        (7, " ".join(f"token=value{i:06d}" for i in range(3000)), "d"),
        (8, "password='" + "x" * 100_000 + "'", "d"),
        (9, "prefix Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg end", "e"),
    ]


def test_edges(spark):
    docs = edge_docs()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    scanned = secret_scans.report(secret_scans.scan(df))
    assert got(scanned) == expected(docs)
    bare = [r.spans for r in scanned.collect() if r.doc_id == 9]
    assert bare == ["bare:7:37"]
    assert secret_scans.report(secret_scans.scan(df.limit(0))).count() == 0


def test_widely_owned_values_are_examples(spark):
    live, example = "token=live0123456789", "token=example0123456"
    docs = [(i, f"a {example} b {live if i == 0 else ''} {{c}}", f"s{i % 9}") for i in range(40)]
    df = spark.createDataFrame([(*d, "x", i) for i, d in enumerate(docs)], SCHEMA)
    out = {r.doc_id: r for r in secret_scans.redact(df).collect()}
    assert out[0].text == f"a {example} b [SECRET] {{c}}"
    assert out[5].text == docs[5][1] and out[5].spans == "x" and out[5].hash == 5
    assert len(out) == 40


def test_redaction_merges_overlaps_and_keeps_rows(spark):
    hexa = "0123456789abcdef" * 2
    docs = [(1, f"token={hexa} é", "a"), (2, None, None), (2, None, None), (3, f"{hexa}", "b"), (4, "plain", "c")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    out = sorted((r.doc_id, r.text) for r in secret_scans.redact(df).where("text is not null").collect())
    assert out == [(1, "[SECRET] é"), (3, "[SECRET]"), (4, "plain")]
    assert secret_scans.redact(df).count() == 5


def test_hot_values_are_counted_by_owner(spark):
    df = spark.range(3000).selectExpr(
        "id as doc_id", "concat('password=hot', '12345678') as text", "concat('s', id % 4) as source", "'' as spans", "1 as hash"
    )
    rows = secret_scans.report(secret_scans.scan(df)).groupBy("n_live").count().collect()
    assert [tuple(r) for r in rows] == [(0, 3000)]


def test_a_key_stays_live_however_often_its_owner_copies_it(spark):
    bare = "Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg"
    text = f"concat('see {bare} or token=live0123456789', if(id < 1000, '', '_'))"
    df = spark.range(3000).selectExpr("id as doc_id", f"{text} as text", "'hot' as source")
    others = spark.range(3000, 3006).selectExpr("id as doc_id", f"'quoted {bare}' as text", "concat('s', id) as source")
    more = spark.range(4000, 4020).selectExpr("id as doc_id", "'nothing' as text", "concat('n', id) as source")
    df = df.unionByName(others).unionByName(more)
    rows = secret_scans.report(secret_scans.scan(df)).groupBy("n_live", F.contains("spans", F.lit("bare"))).count()
    assert sorted(map(tuple, rows.collect())) == [(0, False, 20), (1, True, 6), (2, True, 3000)]
    assert secret_scans.redact(df).where(f"text like '%{bare}%' or text like '%live0%'").count() == 0


def test_examples_are_spread_over_owners(spark):
    """One held alike by 6 of 40 owners; one of a hot owner that over half of all owners hold; each is left alone."""
    alike = [(i, "password=alike0123", f"s{i % 6}") for i in range(60)]
    widely = [(100 + i, "token=widely01234", "hot") for i in range(500)] + [(700 + i, "token=widely01234", f"s{i}") for i in range(25)]
    rest = [(800 + i, None, f"s{i}") for i in range(39)]
    df = spark.createDataFrame([(*d, "x", 1) for d in alike + widely + rest], SCHEMA)
    assert secret_scans.report(secret_scans.scan(df)).where("n_live > 0").count() == 0
    assert secret_scans.redact(df).where("text like '%[SECRET]%'").count() == 0


def test_owner_counts(spark):
    spans = "array<struct<hash:bigint>>"
    rows = [([(7,)], "a")] * 30 + [([(7,), (8,)], "b")] + [([(8,)], None)]
    found = spark.createDataFrame(rows, f"spans {spans}, source string")
    got = {r.hash: tuple(r)[1:] for r in secret_scans.ownership(found).collect()}
    assert got[7][:2] == (31, 2) and abs(got[7][2] - 31**2 / (30**2 + 1)) < 1e-9
    assert got[8] == (2, 2, 2.0)
