"""Quality rules against plain Python."""

import re
from collections import Counter

from recordlens.llm import quality_rules
from recordlens.llm.queries import op8_quality_rules

SCHEMA = "doc_id long, text string, n_words string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def fails(line):
    words = WORD.findall(line)
    bars = line.count("|")
    marks = sum(c in "#*$%&|<>" for c in re.sub(r"([#*$%&|<>])\1+", r"\1", line))
    return (
        (bars >= 3 and bars * 4 >= len(words))
        or marks + line.count("!!") > 0.3 * len(words)
        or 0 < len(words) <= 8 * sum(len(p.split()) for p in quality_rules.PHRASES if p in line.lower())
    )


def lost(text):
    lines = [line for line in (text or "").split("\n") if WORD.search(line) and fails(line)]
    return sum(len(w) for line in lines for w in WORD.findall(line))


def expected(docs):
    out = []
    for i, text in docs:
        b = base(text)
        out.append((i, *b, not b[-1] and lost(text) <= 0.5 * b[1]))
    return sorted(out, key=repr)


NAMES = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_whole_table_equals_brute_force(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op8_quality_rules(spark, tables)) == expected(docs)


def test_good_documents_are_kept_and_junk_goes(spark, tables):
    labels = spark.read.parquet(f"{tables}/labels.parquet").where("quality is not null")
    rows = op8_quality_rules(spark, tables).join(labels, "doc_id").where("n_words >= 10").collect()
    good = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.4 * len(junk)


def edge_docs():
    sentence = "one two three four five six seven eight nine ten eleven."
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r \n"),
        (4, sentence),
        (4, sentence),
        (5, sentence + "\n" + sentence + "\n\n" + sentence),
        (6, "a " * 9),
        (7, "a b c d e f g h i a b c d e j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"),
        (None, "Home | About | Help | More\n" + sentence),
        (8, "Home | About | Help | More | Again | Other\nwords words2 words3 words4"),
        (9, "é😀\u00a0x " * 3 + sentence),
        (10, " ".join(f"w{i % 7919}" for i in range(60_000))),
        (11, "GO!! " * 3 + sentence + "\nWe use cookies, JavaScript and more of them here."),
    ]


def test_edges(spark):
    docs = edge_docs()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    assert got(quality_rules.judge(df)) == expected(docs)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_a_long_line_that_names_a_phrase_stays(spark):
    line = "The baker told us that a good cookie needs cold butter, brown sugar, a warm oven and some patience on a winter evening."
    docs = [(1, line), (2, line + "\nAll rights reserved."), (3, line + "\nWe use cookies. Click here to sign up.")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    assert got(quality_rules.judge(df)) == expected(docs)
    assert [r.text for r in quality_rules.clean(df).orderBy("doc_id").collect()] == [line] * 3


def test_clean_removes_failed_lines(spark):
    df = spark.createDataFrame([(*d, "x", 1) for d in edge_docs()], SCHEMA)
    out = {r.doc_id: r for r in quality_rules.clean(df).collect()}
    wanted = {r[0] for r in expected(edge_docs()) if r[-1]}
    assert set(out) == wanted
    assert out[None].text == "one two three four five six seven eight nine ten eleven."
    assert out[None].n_words == "x" and out[None].kept == 1
