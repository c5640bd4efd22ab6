"""Language identification: a linear-chain conditional random field labels every word of a text.

A word is a run of letters. Its features are the lower-cased word (lexicon), prefixes and suffixes of 1 to 4
characters (affixes) and the 2- and 3-grams inside it, hashed into 2**18 rows of weights, one per language.
Learned transitions tie neighbouring words together, and forward-backward gives every word its marginals, so
a text may switch languages. The text's language is the one with the largest mean marginal, its score that mean.

Training is on a bounded sample: at most ``rows`` documents per language, those with the smallest hash of their id,
and at most ``words_per_row`` consecutive words of each. Words get their document's language, and training
sequences are spliced from documents of different languages, so that the transitions learn to switch.
Prediction reads whole texts; emissions are computed in segments cut between words.

Defined cases: null texts and texts without a letter get ``und`` and score 0. With no training rows every text gets
``und``. Ties go to the language that sorts first. Repeated rows are labelled one by one, extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from recordlens.llm.toxicity import remainder

BITS = 18
AFFIXES = (1, 2, 3, 4)
GRAMS = (2, 3)
SEGMENT = 1 << 18
UNKNOWN = "und"
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Model:
    """Languages in order, emission weights (rows, languages), transition and start weights."""

    languages: tuple[str, ...]
    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * MIX + np.uint64(kind)
    return ((mixed * PRIME) >> np.uint64(64 - BITS)).astype(np.int64)


class Words:
    """The words of a run of code points and the places of their features."""

    def __init__(self, points: np.ndarray):
        is_letter = _letters()[points]
        edge = np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]]))
        self.start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.length = end - self.start
        self.end = end
        self.points = points.astype(np.uint64) + np.uint64(1)
        self.rolled = {1: self.points * PRIME}
        for n in range(2, max(AFFIXES) + 1):
            self.rolled[n] = (self.rolled[n - 1][:-1] + self.points[n - 1 :] * np.uint64(n * n + 7)) * PRIME

    def affixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, slot) for whole words, prefixes and suffixes."""
        every = np.arange(len(self.start))
        inside = np.arange(self.length.sum()) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        at = np.repeat(self.start, self.length) + inside
        place = (inside.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * MIX
        mixed = self.points[at] * PRIME ^ place
        mixed = (mixed ^ (mixed >> np.uint64(30))) * MIX
        if len(every):
            yield every, _slot(np.add.reduceat(mixed, np.cumsum(self.length) - self.length), 1)
        for n in AFFIXES:
            long = np.flatnonzero(self.length >= n)
            yield long, _slot(self.rolled[n][self.start[long]], 10 + n)
            yield long, _slot(self.rolled[n][self.end[long] - n], 20 + n)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, slot) for n-grams, words in order; words shorter than n are absent."""
        for n in GRAMS:
            count = np.maximum(self.length - n + 1, 0)
            word = np.repeat(np.arange(len(self.start)), count)
            at = np.repeat(self.start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield word, _slot(self.rolled[n][at], 30 + n)


def emissions(words: Words, weights: np.ndarray) -> np.ndarray:
    """Sum of feature weights per word and language."""
    out = np.zeros((len(words.start), weights.shape[1]), np.float32)
    for word, slot in words.affixes():
        out[word] += weights[slot]
    for word, slot in words.grams():
        if len(word):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] += np.add.reduceat(weights[slot], first, axis=0)
    return out


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _segments(points: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of about SEGMENT code points, cut where no word is open."""
    at = 0
    while at < len(points):
        cut = at + SEGMENT
        while cut < len(points) and _letters()[points[cut]]:
            gap = np.flatnonzero(~_letters()[points[cut : cut + SEGMENT]])
            cut = cut + int(gap[0]) if len(gap) else cut + SEGMENT
        yield points[at:cut]
        at = cut


def batch_emissions(texts: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of all words of the texts in order, and the number of words of each text."""
    found, counts = [], np.zeros(len(texts), np.int64)
    parts, owners, size = [], [], 0

    def flush():
        if parts:
            words = Words(np.concatenate(parts))
            found.append(emissions(words, weights))
            ends = np.cumsum([len(p) for p in parts])
            np.add.at(counts, np.array(owners)[np.searchsorted(ends, words.start, "right")], 1)
            parts.clear(), owners.clear()

    space = np.array([32], np.uint32)
    for row, text in enumerate(texts):
        if not text:
            continue
        for piece in _segments(points_of(text)):
            parts.append(np.concatenate([piece, space]))
            owners.append(row)
            size += len(piece)
            if size >= SEGMENT:
                flush()
                size = 0
    flush()
    return (np.concatenate(found) if found else np.zeros((0, weights.shape[1]), np.float32)), counts


def marginals(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over many sequences that lie one after the other; scaled, in place of logarithms.

    Sequences are taken longest first, so step t works on the rows that still have a word t.
    """
    local = np.exp(np.clip(emission - emission.max(axis=1, keepdims=True), -60, 0))
    move = np.exp(transition - transition.max()).astype(local.dtype)
    begin = np.exp(start - start.max()).astype(local.dtype)
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")
    forward = np.empty_like(local)
    state = None
    for t in range(steps):
        at = first[: active[t]] + t
        state = local[at] * (begin if t == 0 else state[: active[t]] @ move)
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    back = np.ones((active[steps - 1] if steps else 0, local.shape[1]), local.dtype)
    for t in range(steps - 1, -1, -1):
        at = first[: active[t]] + t
        if len(back) < len(at):
            back = np.concatenate([back, np.ones((len(at) - len(back), local.shape[1]), local.dtype)])
        both = forward[at] * back
        forward[at] = both / both.sum(axis=1, keepdims=True)
        back = (back * local[at]) @ move.T
        back /= back.sum(axis=1, keepdims=True)
    return forward


def fit(rows: list[tuple[str, str]], words_per_row: int = 300, span: int = 24, epochs: int = 4, seed: int = 11) -> Model:
    """Train on (text, language) rows by AdaGrad on the exact likelihood of spliced sequences of ``span`` words."""
    languages = tuple(sorted({lang for _, lang in rows}))
    if not languages:
        return Model((), np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    size = len(languages)
    weights = np.zeros((1 << BITS, size), np.float32)
    transition, start = np.zeros((size, size)), np.zeros(size)
    grams: dict[int, list] = {lang: [] for lang in range(size)}
    for text, lang in rows:
        words = Words(np.append(points_of(text), np.uint32(32)))
        total = len(words.start)
        if not total:
            continue
        low = int(rng.integers(0, max(1, total - words_per_row + 1)))
        pairs = [(w, s) for w, s in (*words.affixes(), *words.grams())]
        word, slot = np.concatenate([w for w, _ in pairs]), np.concatenate([s for _, s in pairs])
        keep = (word >= low) & (word < low + words_per_row)
        word, slot = word[keep] - low, slot[keep]
        by_word = np.argsort(word, kind="stable")
        cuts = np.searchsorted(word[by_word], np.arange(1, min(total, words_per_row)))
        grams[languages.index(lang)] += np.split(slot[by_word], cuts)
    stock = [np.array(words, object) for words in grams.values()]
    if not any(len(s) for s in stock):
        return Model((), weights[:, :0], transition[:0, :0], start[:0])
    used = [lang for lang in range(size) if len(stock[lang])]
    sums = np.full((1 << BITS, size), 1e-6, np.float32)
    sums_t, sums_s = np.full((size, size), 1e-6), np.full(size, 1e-6)
    per_batch = 256
    batches = max(8, epochs * sum(map(len, stock)) // (span * per_batch))
    for _ in range(batches):
        gold = np.empty((per_batch, span), np.int64)
        gold[:, 0] = rng.choice(used, per_batch)
        for t in range(1, span):
            switch = rng.random(per_batch) < 0.08
            gold[:, t] = np.where(switch, rng.choice(used, per_batch), gold[:, t - 1])
        flat = gold.ravel()
        chosen = np.empty(len(flat), object)
        for lang in used:
            mine = np.flatnonzero(flat == lang)
            begins = rng.integers(0, len(stock[lang]), len(mine))
            chosen[mine] = stock[lang][begins]
        lengths = np.fromiter(map(len, chosen), np.int64, len(chosen))
        slots = np.concatenate(list(chosen))
        owner = np.repeat(np.arange(len(flat)), lengths)
        emission = np.add.reduceat(weights[slots], np.cumsum(lengths) - lengths, axis=0)
        grad_e, grad_t, grad_s = _gradient(emission.reshape(per_batch, span, size), gold, transition, start)
        used_slots, inverse = np.unique(slots, return_inverse=True)
        grad = np.empty((len(used_slots), size), np.float32)
        flat_grad = grad_e.reshape(-1, size)
        for lang in range(size):
            grad[:, lang] = np.bincount(inverse, flat_grad[owner, lang], len(used_slots))
        grad = grad / per_batch
        sums[used_slots] += grad**2
        weights[used_slots] -= 0.1 * grad / np.sqrt(sums[used_slots])
        sums_t += (grad_t / per_batch) ** 2
        transition -= 0.1 * grad_t / per_batch / np.sqrt(sums_t)
        sums_s += (grad_s / per_batch) ** 2
        start -= 0.1 * grad_s / per_batch / np.sqrt(sums_s)
    return Model(languages, weights, transition, start)


def _gradient(emission: np.ndarray, gold: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Expected minus observed features of equally long sequences: emissions, transitions, starts."""
    n, span, size = emission.shape
    local = np.exp(emission - emission.max(axis=2, keepdims=True)).astype(np.float64)
    move, begin = np.exp(transition - transition.max()), np.exp(start - start.max())
    alpha, beta = np.empty((span, n, size)), np.empty((span, n, size))
    for t in range(span):
        alpha[t] = local[:, t] * (begin if t == 0 else alpha[t - 1] @ move)
        alpha[t] /= alpha[t].sum(axis=1, keepdims=True)
    beta[-1] = 1
    for t in range(span - 2, -1, -1):
        beta[t] = (beta[t + 1] * local[:, t + 1]) @ move.T
        beta[t] /= beta[t].sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=2, keepdims=True)
    grad_e = both.transpose(1, 0, 2).copy()
    rows = np.arange(n)
    for t in range(span):
        grad_e[rows, t, gold[:, t]] -= 1
    grad_t = np.zeros_like(transition)
    for t in range(1, span):
        pair = alpha[t - 1][:, :, None] * move[None] * (local[:, t] * beta[t])[:, None, :]
        grad_t += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        np.add.at(grad_t, (gold[:, t - 1], gold[:, t]), -1)
    return grad_e, grad_t, grad_e[:, 0].sum(axis=0)


def train_on(docs: DataFrame, rows: int = 400, window: int = 4096, most_languages: int = 256) -> Model:
    """Fit on at most ``rows`` documents per language, without every fourth by hash.

    Of each, one window of at most ``window`` characters at a place set by the id's hash is fetched, so the sample
    on the driver is bounded however long the texts are. All languages are learned; as each takes a megabyte of weights,
    over ``most_languages`` distinct labels are an error.
    """
    usable = docs.where("lang is not null and doc_id is not null and text is not null")
    usable = usable.where(remainder(F.col("doc_id"), 4) != 2)
    labels = usable.select("lang").distinct().orderBy("lang").limit(most_languages + 1)
    languages = [r.lang for r in labels.collect()]
    if len(languages) > most_languages:
        raise ValueError(f"over {most_languages} distinct values of lang; clean them or raise most_languages")
    picked = None
    for lang in languages:
        ids = usable.where(F.col("lang") == lang).select("doc_id", "lang")
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = ids if picked is None else picked.unionByName(ids)
    if picked is None:
        return fit([])
    picked = picked.distinct()
    spare = F.greatest(F.length("text") - window, F.lit(0)) + 1
    cut = F.substring("text", (F.pmod(F.xxhash64("doc_id"), spare) + 1).cast("int"), F.lit(window))
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])
    texts = texts.select("doc_id", "lang", cut.alias("text")).orderBy("doc_id", "lang", "text")
    return fit([(r.text, r.lang) for r in texts.limit(rows * len(languages)).collect()])


def label_words(text: str, model: Model) -> list[tuple[str, str]]:
    """(word, language) for every word of one text, by the largest marginal."""
    emission, counts = batch_emissions([text], model.emission)
    words = Words(points_of(text))
    best = marginals(emission, counts, model.transition, model.start).argmax(axis=1)
    lower = text.lower()
    return [(lower[s:e], model.languages[k]) for s, e, k in zip(words.start, words.end, best)]


def _chunks(texts: list, most: int = 12 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together."""
    low = size = 0
    for high, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= most or high == len(texts):
            yield low, high
            low, size = high, 0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            names, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            texts = batch.tolist()
            for low, high in _chunks(texts) if model.languages else ():
                emission, counts = batch_emissions(texts[low:high], model.emission)
                some = np.flatnonzero(counts)
                if len(some):
                    each = marginals(emission, counts, model.transition, model.start)
                    begin = (np.cumsum(counts) - counts)[some]
                    mean = np.add.reduceat(each, begin, axis=0, dtype=np.float64) / counts[some, None]
                    names[low + some] = np.array(model.languages, object)[mean.argmax(axis=1)]
                    scores[low + some] = np.minimum(mean.max(axis=1), 1.0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    label = F.pandas_udf(predicted, "lang_pred string, score double")
    return docs.select("doc_id", label("text").alias("found")).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"),
        "found.lang_pred",
        "found.score",
    )
