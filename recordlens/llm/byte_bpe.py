"""Byte-level BPE: distinct words are folded by ranked merges, texts are put together from them.

1. Texts are split by the pattern, and every block of texts (up to ``block`` characters of one task) keeps its
   distinct words as arrays of byte tokens. No shuffle: a block stays in its task.
2. Each distinct word of a block is folded: in every step the adjacent pair with the lowest rank, the leftmost of
   equals, is merged, until no pair has a rank. All words of a block take their step together as NumPy arrays, and
   finished ones leave; a word of over ``LONG`` bytes is folded by a heap of its pairs instead, in n log n.
3. The ids of every text are gathered from those of its words. Decoding joins the byte pieces of the ids.

The ranks of pairs are two broadcast arrays (the rows of a sparse matrix, displaced into each other) of fixed size: they
depend on the vocabulary, not on the data.

Defined cases: null text is empty and gives no ids. Repeated rows are encoded one by one; a null id is kept. Other
columns are ignored, an empty table gives an empty result. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

NONE = 1 << 20  # above all ranks
EMPTY = 1 << 41  # gives at least NONE with any left token
LONG = 128
BLOCK = 12 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Byte pieces by id, and the pattern that splits texts."""

    pieces: tuple[bytes, ...]
    pattern: str

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        """A rank file: a base64 piece and its rank per line; ranks run from 0 without gaps."""
        with open(path, "rb") as lines:
            ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
        return Vocabulary(tuple(ranks[i] for i in range(len(ranks))), pattern)

    def pair_ranks(self) -> dict[int, int]:
        """left << 20 | right -> rank, for every way to make a piece of two others."""
        ids = {piece: i for i, piece in enumerate(self.pieces)}
        found = {}
        for rank, piece in enumerate(self.pieces):
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    found[left << 20 | right] = rank
        return found


@dataclass(frozen=True)
class PairRanks:
    """The sparse matrix of pair ranks as displaced rows.

    The rank of (left, right) is ``cells[offset[left] + right] ^ left << 20``; a cell of another row or an empty one
    gives a number of at least NONE.
    """

    offsets: np.ndarray
    cells: np.ndarray

    @staticmethod
    def of(pairs: dict[int, int], size: int, seed: int = 3) -> PairRanks:
        """The fullest rows are placed first, at drawn places that are free."""
        rows: dict[int, list[int]] = {}
        for key in pairs:
            rows.setdefault(key >> 20, []).append(key & (NONE - 1))
        rng = np.random.default_rng(seed)
        cells = np.full(size + 6 * len(pairs), EMPTY)
        offsets = np.zeros(size, np.int64)
        for left, rights in sorted(rows.items(), key=lambda row: (-len(row[1]), row[0])):
            columns = np.array(rights)
            at = 0
            while (cells[at + columns] != EMPTY).any():
                at = int(rng.integers(0, len(cells) - size))
            cells[at + columns] = [left << 20 | pairs[left << 20 | right] for right in rights]
            offsets[left] = at
        return PairRanks(offsets, cells)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is none."""
        return np.minimum(self.cells[self.offsets[left] + right] ^ (left << 20), NONE)


def _next_ranks(tokens: np.ndarray, starts: np.ndarray, rank: PairRanks) -> np.ndarray:
    """Per token the rank of its pair with the next one; NONE for the last of a word."""
    ranks = np.append(rank(tokens[:-1], tokens[1:]), NONE)
    ranks[starts[1:] - 1] = NONE
    return ranks


def fold_words(tokens: np.ndarray, lengths: np.ndarray, rank: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and their numbers per word, from byte tokens; no word is empty."""
    if not len(lengths):
        return tokens, lengths
    word, done = np.arange(len(lengths)), []
    long = lengths > LONG
    if long.any():
        bounds = np.cumsum(lengths)
        for w in np.flatnonzero(long).tolist():
            ids = _fold_long(tokens[bounds[w] - lengths[w] : bounds[w]], rank)
            done.append((np.array([w]), np.array([len(ids)]), ids))
        tokens, word, lengths = tokens[np.repeat(~long, lengths)], word[~long], lengths[~long]
    starts = np.cumsum(lengths) - lengths
    ranks = _next_ranks(tokens, starts, rank) if len(word) else tokens
    while len(word):
        # The lowest rank of every word with its leftmost place.
        lowest = np.minimum.reduceat(ranks << 32 | np.arange(len(ranks)), starts)
        merged, at = lowest >> 32, lowest & 0xFFFFFFFF
        go = merged < NONE
        if not go.all():
            still = np.repeat(go, lengths)
            done.append((word[~go], lengths[~go], tokens[~still]))
            inside = (at - starts)[go]
            tokens, ranks, word, lengths, merged = tokens[still], ranks[still], word[go], lengths[go], merged[go]
            if not len(word):
                break
            at = np.cumsum(lengths) - lengths + inside
        tokens[at] = merged
        kept = np.ones(len(tokens), bool)
        kept[at + 1] = False
        tokens, ranks, lengths = tokens[kept], ranks[kept], lengths - 1
        ends = np.cumsum(lengths)
        starts, at = ends - lengths, at - np.arange(len(at))  # every word before lost one token
        ranks[at] = NONE
        for p in (at[at + 1 < ends], at[at > starts] - 1):
            ranks[p] = rank(tokens[p], tokens[p + 1])
    return _in_order(done)


def _in_order(done: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(words, lengths, ids) in any order to the ids and lengths by word."""
    words, lengths, ids = (np.concatenate(part) for part in zip(*done))
    by_word = np.empty(len(words), np.int64)
    by_word[words] = lengths
    starts = np.cumsum(by_word) - by_word
    out = np.empty(len(ids), np.int64)
    out[np.repeat(starts[words] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(ids))] = ids
    return out, by_word


def _fold_long(tokens: np.ndarray, rank: PairRanks) -> np.ndarray:
    """Ids of one word, by a heap of (rank, place); an entry whose pair has changed since is skipped."""
    n, ids = len(tokens), tokens.tolist()
    ranks = _next_ranks(tokens, np.zeros(1, np.int64), rank).tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(ranks) if r < NONE]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        if ranks[i] != r:
            continue
        gone, ids[i] = after[i], r
        after[i], ranks[gone] = after[gone], NONE
        if after[i] < n:
            before[after[i]] = i
        for left in (i, before[i]):
            if left >= 0:
                right = after[left]
                ranks[left] = int(rank(np.int64(ids[left]), np.int64(ids[right]))) if right < n else NONE
                if ranks[left] < NONE:
                    heappush(heap, (ranks[left], left))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return np.array(out, np.int64)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


class _Block(NamedTuple):
    """Texts of a block as codes of its distinct words, and these words."""

    doc_ids: list
    counts: np.ndarray
    codes: np.ndarray
    words: list[bytes]


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, block: int) -> Iterator[_Block]:
    """Batches of (doc_id, text) to blocks of up to ``block`` characters and the text that passes it."""
    import regex

    find = regex.compile(pattern).findall
    codes, ids, parts, size = _Codes(), [], [], 0

    def taken() -> _Block:
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return _Block(ids, counts, np.concatenate(parts), [w.encode() for w in codes])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = find(text.as_py() or "")
            ids.append(doc_id)
            parts.append(np.fromiter(map(codes.__getitem__, found), np.int32, len(found)))
            size += sum(map(len, found))
            if size >= block:
                yield taken()
                codes, ids, parts, size = _Codes(), [], [], 0
    if ids:
        yield taken()


def _ids_of(block: _Block, byte_ids: np.ndarray, rank: PairRanks) -> Iterator[tuple[list, list[bytes]]]:
    """doc_ids of a block and their ids as little-endian unsigned 32-bit integers."""
    tokens = byte_ids[np.frombuffer(b"".join(block.words), np.uint8)]
    values, length = fold_words(tokens, np.fromiter(map(len, block.words), np.int64, len(block.words)), rank)
    values, offsets = values.astype("<u4"), np.cumsum(length) - length
    ends = np.concatenate([[0], np.cumsum(block.counts)])
    low = 0
    while low < len(block.counts):  # texts by half a million words, to bound the index arrays
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + (1 << 19), "right")) - 1)
        part = block.codes[ends[low] : ends[high]]
        each = length[part]
        stop = np.cumsum(each)
        at = np.repeat(offsets[part] - (stop - each), each) + np.arange(int(stop[-1]) if len(stop) else 0)
        joined = values[at].tobytes()
        bound = np.concatenate([[0], stop])[ends[low : high + 1] - ends[low]] * 4
        yield block.doc_ids[low:high], [joined[a:b] for a, b in zip(bound[:-1], bound[1:])]
        low = high


def _encoder(docs: DataFrame, vocabulary: Vocabulary, block: int):
    """A function for tasks: batches of (doc_id, text) to lists of doc_ids and their ids."""
    single = {piece[0]: i for i, piece in enumerate(vocabulary.pieces) if len(piece) == 1}
    byte_ids = np.array([single[b] for b in range(256)], np.int64)
    rank = PairRanks.of(vocabulary.pair_ranks(), len(vocabulary.pieces))
    shared = docs.sparkSession.sparkContext.broadcast((rank.offsets, rank.cells))
    pattern = vocabulary.pattern

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        ranks = PairRanks(*shared.value)
        for taken in _blocks(batches, pattern, block):
            yield from _ids_of(taken, byte_ids, ranks)

    return encoded


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def encode(docs: DataFrame, vocabulary: Vocabulary, block: int = BLOCK) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers in one binary) of every text."""
    encoded = _encoder(docs, vocabulary, block)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in encoded(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
            )

    return _texts(docs).mapInArrow(gather, "doc_id bigint, ids binary")


def join_pieces(ids: bytes, pieces: tuple[bytes, ...]) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(ids: Column, vocabulary: Vocabulary, spark) -> Column:
    """The bytes that the ids stand for; null stays null."""
    shared = spark.sparkContext.broadcast(vocabulary.pieces)

    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else join_pieces(x, shared.value) for x in batch])

    return F.pandas_udf(join, "binary")(ids)


def digests(docs: DataFrame, vocabulary: Vocabulary, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them.

    Decodes in the task that gathers the ids, so that they do not travel once more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.pieces)
    encoded = _encoder(docs, vocabulary, block)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in encoded(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(join_pieces(x, shared.value)).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _texts(docs).mapInArrow(
        digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
