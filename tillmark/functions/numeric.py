"""Column helpers that keep IEEE-754 meaning on top of Spark's NULL handling.

A missing number is NULL everywhere in this package.  NaN and infinities are
only allowed to live inside an expression: a weight may be NaN (0 / 0) or
infinite (x / 0) between :func:`ieee_div` and :func:`ieee_pow`, and must then
still obey the two identities ``x ** 0 = 1`` and ``1 ** x = 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POS_INF = float("inf")
NEG_INF = float("-inf")
NAN = float("nan")


def number(c: Column) -> Column:
    """Double with NaN mapped to NULL (the package's single missing value)."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def ieee_div(num: Column, den: Column) -> Column:
    """``num / den`` with x/0 = +-inf and 0/0 = NaN instead of an ANSI error."""
    by_zero = (
        F.when(F.isnan(num) | (num == 0), F.lit(NAN))
        .when(num > 0, F.lit(POS_INF))
        .when(num < 0, F.lit(NEG_INF))
    )
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def ieee_pow(base: Column, exponent: Column) -> Column:
    """C ``pow``: a missing operand still gives 1 for ``x ** 0`` and ``1 ** x``.

    Java's ``pow`` (what Spark runs) returns NaN for ``1 ** NaN``, ``1 ** inf``
    and ``-1 ** inf``, and SQL returns NULL when either side is NULL.
    """
    return (
        F.when(exponent == 0, F.lit(1.0))
        .when(base == 1, F.lit(1.0))
        .when((base == -1) & exponent.isin(POS_INF, NEG_INF), F.lit(1.0))
        .otherwise(F.pow(base, exponent))
    )


def finite_positive(x: Column) -> Column:
    """``x`` when it is a finite number above zero, else NULL.

    Spark orders NaN above +inf, so the upper bound also removes NaN.
    """
    return F.when((x > 0) & (x < F.lit(POS_INF)), x)


def product_or_null(x: Column) -> Column:
    """Grouped product that skips missing terms; NULL when all are missing."""
    return F.product(F.nanvl(x, F.lit(None).cast("double")))


def is_infinite(x: Column) -> Column:
    return x.isin(POS_INF, NEG_INF)
