"""Values made for reading: percentages, sort keys, timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recordlens.functions.text import is_blank, strip, to_number


def clamp01(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def percent_of_best(score: Column, best: Column) -> Column:
    """Clamped score as a share of the best one, with one decimal and a percent sign."""
    share = F.when(best > 0, F.least(F.lit(100.0), score / best * 100.0)).otherwise(0.0)
    return F.concat(F.format_number(share, 1), F.lit("%"))


def sort_number(value: Column) -> Column:
    """Value of a number or percentage, NULL for other text."""
    return to_number(F.regexp_replace(strip(value), "%$", ""))


def sort_class(value: Column, number: Column) -> Column:
    """0 for numbers and percentages, 1 for other text, 2 for blanks."""
    return F.when(is_blank(value), 2).when(number.isNotNull(), 0).otherwise(1)


def sort_text(value: Column, kind: Column) -> Column:
    return F.when(kind == 1, F.lower(strip(value))).otherwise("")


def short_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy hh:mm a")
