"""Vector arithmetic on ``array<float>`` columns.

Sums run left to right in double precision, so the same input gives the same bits anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

MIN_NORM = 1e-12
UNIT_TOLERANCE = 1e-3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    """Dot product; vectors of unequal length raise instead of giving NULL."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)
    message = F.lit("vectors differ in length")
    return F.when(F.size(a) != F.size(b), F.raise_error(message)).otherwise(total)


def norm(v: Column) -> Column:
    squares = F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def checked(v: Column) -> Column:
    """The vector itself; a NULL element raises instead of turning the norm into NULL."""
    message = F.lit("vector has a NULL element")
    return F.when(F.exists(v, lambda x: x.isNull()), F.raise_error(message)).otherwise(v)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy in float precision; a zero vector stays zero."""

    def scaled(vector: Column) -> Column:
        return let(
            F.greatest(norm(vector), F.lit(MIN_NORM)),
            lambda n: F.transform(vector, lambda x: (x.cast("double") / n).cast("float")),
        )

    return let(checked(v), scaled)


def has_unit_norm(v: Column, tolerance: float = UNIT_TOLERANCE) -> Column:
    """Norm within ``tolerance`` of one; NULL and non-finite vectors fail."""
    return let(
        norm(v),
        lambda n: F.coalesce(~F.isnan(n) & (F.abs(n - 1.0) <= F.lit(tolerance)), F.lit(False)),
    )
