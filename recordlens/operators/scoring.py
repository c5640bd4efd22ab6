"""Keyword boosts and the blended score, as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recordlens.functions.text import strip

# Boosts for id, title and body hits; weights of vector and keyword score.
BOOSTS = (1.0, 0.5, 0.3)
WEIGHTS = (0.75, 0.25)


def keyword_score(
    query: Column, work_item_id: Column, title: Column, body: Column, boosts=BOOSTS
) -> Column:
    """Sum of the boosts whose field matches; NULL or blank operands never match."""
    q = strip(query)
    lowered = F.lower(q)

    def boost(hit: Column, weight: float) -> Column:
        return F.when((q != "") & hit, F.lit(float(weight))).otherwise(F.lit(0.0))

    return (
        boost(q == work_item_id, boosts[0])
        + boost(F.contains(F.lower(title), lowered), boosts[1])
        + boost(F.contains(F.lower(body), lowered), boosts[2])
    )


def blend(semantic: Column, keyword: Column, weights=WEIGHTS) -> Column:
    return F.lit(float(weights[0])) * semantic + F.lit(float(weights[1])) * keyword
