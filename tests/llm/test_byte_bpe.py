"""Byte-level BPE against the public tokenizer library."""

import hashlib
import random
import struct
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from recordlens.llm import byte_bpe
from recordlens.llm.queries import VOCABULARY_FILE, op2_byte_bpe

SCHEMA = "doc_id long, text string, ids string, words int"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.read(public_tokenizers.path(VOCABULARY_FILE), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {piece: i for i, piece in enumerate(vocabulary.pieces)}
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})


def expected(docs, library):
    out = []
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        out.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)


def test_whole_table_equals_library(spark, tables, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op2_byte_bpe(spark, tables)) == expected(docs, library)


def odd_texts():
    rng = random.Random(4)
    alphabets = ["ab", "aeiou ", "théñüß ", "0123 ,.!", " \n\t\r  ", "日本語 中文", "😀👍🏽é́ ", "'st're'LL "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(100)]
    texts += ["a" * 700, "ab" * 300, " " * 500 + "x", "the<|endoftext|>end", "\x00\x01", "x" * 40_000 + " y", "word " * 60_000]
    return texts[:-2] + ["e" * 1500, texts[-1]]


def test_odd_texts(spark, vocabulary, library):
    docs = [(i, t) for i, t in enumerate(odd_texts())] + [(5, None), (6, ""), (6, ""), (None, "null id")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(3)
    assert got(byte_bpe.digests(df, vocabulary)) == expected(docs, library)
    assert byte_bpe.digests(df.limit(0), vocabulary).count() == 0


def test_small_blocks_give_the_same_ids(spark, vocabulary, library):
    docs = [(i, f"some words {i} and more of them, again and again") for i in range(50)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).coalesce(1)
    found = {r.doc_id: r.ids for r in byte_bpe.encode(df, vocabulary, block=100).collect()}
    assert {i: list(struct.unpack(f"<{len(x) // 4}I", x)) for i, x in found.items()} == {
        i: library.encode_ordinary(t) for i, t in docs
    }


def test_decode_column(spark, vocabulary):
    df = spark.createDataFrame([(1, "Grüße 😀"), (2, None)], "doc_id long, text string")
    encoded = byte_bpe.encode(df, vocabulary)
    found = encoded.select("doc_id", byte_bpe.decode(encoded["ids"], vocabulary, spark).alias("text")).collect()
    assert {r.doc_id: bytes(r.text).decode() for r in found} == {1: "Grüße 😀", 2: ""}


@pytest.mark.parametrize("long", [2, 16, 1 << 30])
def test_words_fold_as_in_the_library(vocabulary, library, long, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", long)  # above it by heap, below it all words together
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé日 1") for _ in range(rng.randrange(1, 90))).encode() for _ in range(500)]
    words += [vocabulary.pieces[rng.randrange(len(vocabulary.pieces))] for _ in range(500)] + [b"ab" * 300]
    single = {piece[0]: i for i, piece in enumerate(vocabulary.pieces) if len(piece) == 1}
    tokens = np.array([single[b] for w in words for b in w])
    rank = byte_bpe.PairRanks.of(vocabulary.pair_ranks(), len(vocabulary.pieces))
    ids, lengths = byte_bpe.fold_words(tokens, np.array([len(w) for w in words]), rank)
    want = [library._core_bpe.encode_single_piece(w) for w in words]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_very_long_word_ends(spark, vocabulary, library):
    docs = [(1, "xyab" * 25_000), (2, "e" * 20_000)]
    start = time.monotonic()
    assert got(byte_bpe.digests(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary)) == expected(docs, library)
    assert time.monotonic() - start < 60
