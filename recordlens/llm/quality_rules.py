"""Quality rules, line first: lines are judged one by one, then what is left decides on the document.

Built-in DataFrame functions only, all of them per row: no shuffle and no state.

Line rules (a line with at least one word fails when any holds):

* navigation: at least ``nav_bars`` vertical bars, in relation to its words,
* punctuation: symbols or doubled exclamation marks on more than ``mark_share`` of its words,
* boilerplate: the stock phrases it holds make up at least one of every ``WORDS_A_PHRASE_WORD`` of its words, so a long line
  that names one stays.

Failed lines are removed. A document is kept when its base counts pass and the removed lines hold at most
``max_loss`` of its word characters.

Base counts: words are runs of other than ``[\\x20\\x09-\\x0D]``. A document fails with fewer than 10 words, or
when over 20 % of its words lie in five-word windows that occur twice or more in it.

Defined cases: null text is empty, has no words and fails. Repeated rows are judged one by one. Extra columns
are ignored by the report and kept by ``clean``; an empty table gives an empty result. Lines end at ``\\n`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordlens.llm.common import let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Phrases that mark a line as boilerplate.
PHRASES = (
    "all rights reserved",
    "click here",
    "cookie",
    "javascript",
    "licensed under",
    "privacy policy",
    "sign up",
    "subscribe",
    "terms of use",
)
# A line fails by its phrases when it has at most this many words for each word of them.
WORDS_A_PHRASE_WORD = 8


def words_of(text: Column) -> Column:
    """Runs of other than white space, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows that occur at least twice, the first occurrence included.

    Windows are compared by a 64-bit hash of their words. Sorting (hash, position) brings equal windows
    together, so the work grows with n log n for a text of any length.
    """

    def by_window(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(let(hashes, covered))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            at = F.transform(
                s,
                lambda x, k: F.when(
                    (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])),
                    x["i"],
                ),
            )
            return let(F.array_sort(F.filter(at, lambda i: i.isNotNull())), spread)

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - i, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        once = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(once, F.lit(0).cast("long")).otherwise(let(pairs, twice))

    return let(words, by_window)


def symbols_in(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_fails(line: Column, nav_bars: int = 3, mark_share: float = 0.3) -> Column:
    """Whether a line with words is navigation, all symbols, or boilerplate."""
    lower = F.lower(line)
    n_words = F.size(words_of(line))
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    marks = symbols_in(F.regexp_replace(line, r"([#*$%&|<>])\1+", "$1"))
    shouts = F.floor((F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2)
    held = F.lit(0)
    for text in PHRASES:
        held = held + F.when(lower.contains(text), len(text.split())).otherwise(0)
    boilerplate = (held > 0) & (WORDS_A_PHRASE_WORD * held >= n_words)
    navigation = (bars >= nav_bars) & (bars * 4 >= n_words)
    return navigation | (marks + shouts > mark_share * n_words) | boilerplate


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def removed_chars(text: Column) -> Column:
    """Word characters of the lines that fail."""
    failed = F.filter(F.split(text, "\n"), lambda line: line_fails(line) & line.rlike(r"[^\x20\x09-\x0D]"))
    return F.aggregate(failed, F.lit(0).cast("long"), lambda acc, line: acc + word_chars(line))


def clean_text(text: Column) -> Column:
    """The lines that stay, joined again."""
    stays = F.filter(F.split(text, "\n"), lambda line: ~line_fails(line) | ~line.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_join(stays, "\n")


def judge(docs: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))

    def with_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    found = docs.select(
        "doc_id",
        let(words_of(text), counted).alias("w"),
        word_chars(text).alias("word_chars"),
        symbols_in(text).cast("long").alias("n_symbols"),
        let(lines, with_lines).alias("n_dup_lines"),
        removed_chars(text).alias("n_removed_chars"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lost = F.col("n_removed_chars") > max_loss * F.col("word_chars")
    return (
        found.select(
            "doc_id",
            "w.n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "w.n_repeat_words",
            "n_removed_chars",
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~lost)
    )


def clean(docs: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """The kept documents with their failed lines removed; same columns as ``docs``."""
    text = F.coalesce("text", F.lit(""))
    kept = (
        (F.size(words_of(text)) >= 10)
        & (100 * repeated_words(words_of(text)) <= 20 * F.size(words_of(text)))
        & (removed_chars(text) <= max_loss * word_chars(text))
    )
    return docs.where(kept).withColumn("text", clean_text(F.col("text")))
